"""Vectors and matrices over embeddings, documents and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph, matrix, svd
from lodestone.operators.numbering import numbered
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_UNIT = "WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM u GROUP BY 1), v AS (SELECT u.vec_id, label, pos, x / n AS x, x AS raw FROM u JOIN n USING (vec_id) WHERE n > 0), "


@query(_UNIT + "s AS (SELECT label, pos, sum(x) AS s, count(*) AS n FROM v GROUP BY 1, 2) SELECT label, max(n) AS n, round(2.0 * max(n) / (max(n) - 1) * (1 - least(1.0, sum(s * s) / max(n) ** 2)), 6) AS q FROM s GROUP BY 1 HAVING max(n) >= 2")
def matrix_rao(spark, d):
    """[A31]"""
    return matrix.rao(table(spark, d, "embeddings"), ["label"], "embedding").withColumn("q", F.round("q", 6))


@query("""
WITH r AS (SELECT c_nationkey::BIGINT AS nation, rank() OVER (PARTITION BY c_nationkey ORDER BY n) + (count(*) OVER (PARTITION BY c_nationkey, n) - 1) / 2 AS x, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2 AS y
 FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)
SELECT nation, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(x, y) END, 6) AS rho FROM r GROUP BY 1
""")
def matrix_spearman(spark, d):
    """[A32]"""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    c = table(spark, d, "customer").join(n, "c_custkey").select(F.col("c_nationkey").cast("long").alias("nation"), "k", "c_acctbal")
    return matrix.spearman(c, ["nation"], "k", "c_acctbal").withColumn("rho", F.round("rho", 6))


@query("""
WITH f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_partkey, count(*) AS df, round(ln((1 + (SELECT count(DISTINCT l_orderkey) FROM f)) / (1 + count(*))), 6) AS idf FROM f GROUP BY 1 HAVING count(*) >= 2
""")
def matrix_idf(spark, d):
    """[A33]"""
    f = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    rows = f.select("l_orderkey").distinct().count()
    return matrix.inverse_frequencies(f, "l_orderkey", "l_partkey", rows, 2).withColumn("idf", F.round("idf", 6))


_E = "WITH e AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % 1000 AS dst FROM orders), "


@query(_E + """r0 AS (SELECT DISTINCT src AS row FROM e), h1 AS (SELECT row, dst AS node, count(*) AS n FROM r0 JOIN e ON src = row WHERE dst <> row GROUP BY 1, 2),
h2 AS (SELECT row, e.dst AS node, sum(n) AS n FROM h1 JOIN e ON e.src = h1.node WHERE e.dst <> row AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.row = h1.row AND x.node = e.dst) GROUP BY 1, 2),
l AS (SELECT row, node, 1 AS hop, n FROM h1 UNION ALL SELECT row, node, 2, n FROM h2), i AS (SELECT node, ln((1 + (SELECT count(*) FROM r0)) / (1 + count(DISTINCT row))) AS idf FROM l GROUP BY 1),
v AS (SELECT row, node, hop, n * idf AS v FROM l JOIN i USING (node) WHERE n * idf > 0), w AS (SELECT row, node, v / sqrt(sum(v * v) OVER (PARTITION BY row, hop)) * 0.5 ** (hop - 1) AS v FROM v)
SELECT row, node, round(v / sqrt(sum(v * v) OVER (PARTITION BY row)), 6) AS value FROM w""")
def matrix_hop_balanced(spark, d):
    """[G7]"""
    from lodestone.plans.graph import edges

    e = edges(spark, d)
    rows = e.select(F.col("src").alias("row"), F.col("src").alias("node")).distinct()
    l = graph.layers(e, rows, 2)
    idf = matrix.inverse_frequencies(l, "row", "node", rows.count()).select("node", "idf")
    return matrix.hop_balanced(l, idf, 0.5).withColumn("value", F.round("value", 6))


@query("""
WITH t AS (SELECT p_brand AS g, unnest(string_split(p_type || ' size' || p_size::VARCHAR, ' ')) AS term FROM part UNION ALL SELECT p_brand, p_name FROM part), n AS (SELECT g, term, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT g, sum(n) AS size FROM n GROUP BY 1),
o AS (SELECT term, sum(n) AS total FROM n GROUP BY 1 HAVING count(*) <= greatest(1, floor(0.9 * (SELECT count(*) FROM s)))),
x AS (SELECT n.g, term, round(n / size * ln(1 + (SELECT avg(size) FROM s) / total) * CASE WHEN contains(term, ' ') THEN 1.5 ELSE 1 END, 9) AS score FROM n JOIN o USING (term) JOIN s ON s.g = n.g)
SELECT g, term, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term) AS rank FROM x) WHERE rank <= 5
""")
def matrix_class_terms(spark, d):
    """[A34]"""
    p = table(spark, d, "part")
    words = p.select(F.col("p_brand").alias("g"), F.explode(F.split(F.concat(F.col("p_type"), F.lit(" size"), F.col("p_size").cast("string")), " ")).alias("term"))
    return matrix.class_tf_idf(words.unionByName(p.select(F.col("p_brand").alias("g"), F.col("p_name").alias("term"))), "g", "term", 5, generic=0.9)


@query(_UNIT + "m AS (SELECT label, pos, avg(x) AS m FROM v GROUP BY 1, 2) SELECT label, pos::BIGINT AS dim, greatest(-127, least(127, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)) * 127)))::BIGINT AS value FROM m")
def matrix_centroids(spark, d):
    """[G14]"""
    return matrix.centroids(table(spark, d, "embeddings"), "label", "embedding")


@query(_UNIT + """m AS (SELECT label, pos, avg(raw) AS m FROM v GROUP BY 1, 2), c AS (SELECT label, vec_id, round(sum(raw * m) / (sqrt(sum(raw * raw)) * sqrt(sum(m * m))), 9) AS cosine FROM v JOIN m USING (label, pos) GROUP BY 1, 2)
SELECT label, vec_id, rank, cosine FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM c) WHERE rank <= 3""")
def matrix_exemplars(spark, d):
    """[A35]"""
    return matrix.exemplars(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 3)


@query("""
SELECT id, neighbour, cosine, rank FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5
""")
def matrix_nearest(spark, d):
    """[R7]"""
    return matrix.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query("""
WITH t AS (SELECT (c_nationkey % 8)::BIGINT AS a, (c_custkey % 5)::BIGINT AS b, count(*) AS n FROM customer GROUP BY 1, 2), na AS (SELECT a, sum(n) AS na FROM t GROUP BY 1), nb AS (SELECT b, sum(n) AS nb FROM t GROUP BY 1)
SELECT a, max(na)::BIGINT AS size, round(max(n / (na + nb - n)), 6) AS best, round(max(n / (na + nb - n)), 6) >= 0.5 AS survives FROM t JOIN na USING (a) JOIN nb USING (b) WHERE na >= 5 GROUP BY 1
""")
def matrix_survival(spark, d):
    """[A25, G16]"""
    c = table(spark, d, "customer")
    t = matrix.contingency(c.select("c_custkey", (F.col("c_nationkey") % 8).cast("long").alias("community")), c.select("c_custkey", (F.col("c_custkey") % 5).alias("community")), "c_custkey")
    return matrix.survival(t)


@query("""
WITH l AS (SELECT 0 AS run, vec_id, label::BIGINT AS c FROM embeddings UNION ALL SELECT 1, vec_id, label % 5 FROM embeddings UNION ALL SELECT 2, vec_id, (label + vec_id % 3) % 5 FROM embeddings),
t AS (SELECT x.run AS ra, y.run AS rb, x.c AS a, y.c AS b, count(*) AS n FROM l x JOIN l y USING (vec_id) WHERE x.run < y.run GROUP BY ALL), z AS (SELECT ra, rb, sum(n) AS al, sum(n * (n - 1) / 2) AS cc FROM t GROUP BY ALL),
xa AS (SELECT ra, rb, a, sum(n) AS m FROM t GROUP BY ALL), xb AS (SELECT ra, rb, b, sum(n) AS m FROM t GROUP BY ALL),
ha AS (SELECT ra, rb, sum(m * (m - 1) / 2) AS ca, -sum(m / al * ln(m / al)) AS h FROM xa JOIN z USING (ra, rb) GROUP BY ALL), hb AS (SELECT ra, rb, sum(m * (m - 1) / 2) AS cb, -sum(m / al * ln(m / al)) AS h FROM xb JOIN z USING (ra, rb) GROUP BY ALL),
mi AS (SELECT ra, rb, sum(n / al * ln(al * n / (xa.m * xb.m))) AS mi FROM t JOIN xa USING (ra, rb, a) JOIN xb USING (ra, rb, b) JOIN z USING (ra, rb) GROUP BY ALL),
k AS (SELECT ra, rb, al::DOUBLE AS n, xa.m::DOUBLE AS x, xb.m::DOUBLE AS y, unnest(range(greatest(1, xa.m + xb.m - al)::BIGINT, least(xa.m, xb.m)::BIGINT + 1))::DOUBLE AS k FROM xa JOIN xb USING (ra, rb) JOIN z USING (ra, rb)),
e AS (SELECT ra, rb, sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS emi FROM k GROUP BY ALL),
r AS (SELECT ra AS run_a, rb AS run_b, (cc - ca * cb / (al * (al - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (al * (al - 1) / 2)) AS ari, (mi - emi) / ((ha.h + hb.h) / 2 - emi) AS ami FROM z JOIN ha USING (ra, rb) JOIN hb USING (ra, rb) JOIN mi USING (ra, rb) JOIN e USING (ra, rb))
SELECT run_a, run_b, round(ari, 6) AS ari, round(ami, 6) AS ami, round(avg(ari) OVER (), 6) AS mean_ari, round(stddev_samp(ari) OVER (), 6) AS sd_ari, round(avg(ami) OVER (), 6) AS mean_ami, round(stddev_samp(ami) OVER (), 6) AS sd_ami FROM r
""")
def matrix_agreement(spark, d):
    """[A40] Of three partitions, each two, and their mean and standard deviation."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    runs = F.array(*(F.struct(F.lit(k).alias("run"), c.alias("c")) for k, c in enumerate((F.col("label"), F.col("label") % 5, (F.col("label") + F.col("vec_id") % 3) % 5))))
    pairs = matrix.agreement(e.select("vec_id", F.explode(runs).alias("r")).select("vec_id", "r.*"), "run", "vec_id", "c")
    sums = pairs.agg(*(f(c).alias(f"{n}_{c}") for c in ("ari", "ami") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    r6 = lambda c: F.round(c, 6).alias(c)
    return pairs.join(F.broadcast(sums)).select("run_a", "run_b", *(r6(c) for c in ("ari", "ami", "mean_ari", "sd_ari", "mean_ami", "sd_ami")))


@query("""
WITH p AS (SELECT a.vec_id AS id, b.vec_id AS o, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS whole, round(list_cosine_similarity(a.embedding[1:48]::DOUBLE[], b.embedding[1:48]::DOUBLE[]), 9) AS part FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT id, o, row_number() OVER (PARTITION BY id ORDER BY whole DESC, o) <= 10 AS x, row_number() OVER (PARTITION BY id ORDER BY part DESC, o) <= 10 AS y FROM p)
SELECT id, round(count(*) FILTER (x AND y) / count(*) FILTER (x OR y), 6) AS jaccard FROM r GROUP BY 1
""")
def matrix_neighbour_overlap(spark, d):
    """[G15]"""
    e = table(spark, d, "embeddings")
    out = matrix.neighbour_overlap(matrix.nearest(e, "vec_id", "embedding", 10), matrix.nearest(e.withColumn("embedding", F.slice("embedding", 1, 48)), "vec_id", "embedding", 10), 10)
    return out.select("id", F.round("jaccard", 6).alias("jaccard"))


@query()
def matrix_latent(spark, d):
    """[G13] Of suppliers by all parts."""
    f = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg((1 + F.log(F.count("*").cast("double"))).alias("v"))
    return svd.latent(f, 8, "l_suppkey", "l_partkey", "v").rows.withColumnRenamed("row", "l_suppkey")


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM benchmark), v AS (SELECT word, embedding AS e FROM (SELECT word, row_number() OVER (ORDER BY word) - 1 AS k FROM w) JOIN embeddings ON vec_id = k),
n AS (SELECT doc_id, word, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) GROUP BY 1, 2),
s AS (SELECT doc_id, i, sum(tf * e[i]) AS x FROM n JOIN v USING (word), range(1, 5) r(i) GROUP BY 1, 2), u AS (SELECT doc_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM s)
SELECT d.doc_id, round(coalesce(max(x) FILTER (i = 1), 0), 6) AS v1, round(coalesce(max(x) FILTER (i = 2), 0), 6) AS v2, round(coalesce(max(x) FILTER (i = 3), 0), 6) AS v3, round(coalesce(max(x) FILTER (i = 4), 0), 6) AS v4
FROM (SELECT DISTINCT doc_id FROM n) d LEFT JOIN u ON u.doc_id = d.doc_id GROUP BY 1
""")
def matrix_fold_in(spark, d):
    """[G13] Documents in a space whose words are the benchmark's, with the embeddings as their vectors."""
    words = lambda t: F.explode(F.regexp_extract_all(F.lower(t), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")
    known = numbered(table(spark, d, "benchmark").select(words("text")).distinct(), [(F.col("word"), True)], "vec_id")
    vocabulary = known.join(table(spark, d, "embeddings"), "vec_id").select("word", F.col("embedding").alias("vector"))
    out = svd.folded(table(spark, d, "documents").select("doc_id", words("text")), vocabulary, 4)
    return out.select("doc_id", *(F.round(F.get("vector", F.lit(k)), 6).alias(f"v{k + 1}") for k in range(4)))
