"""Ranked hits, the directory's filter, query vectors, and gates over roles, windows and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import gates, graph, search
from lodestone.plans.registry import query
from lodestone.plans.search import _AREAS, areas, texts
from lodestone.sources.tables import table


@query(_AREAS + """
, b AS (SELECT l_suppkey, area, share FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY share DESC, level DESC, area) AS r FROM a WHERE contains(lower(area), '#4')) WHERE r = 1)
SELECT l_suppkey, area, row_number() OVER (ORDER BY (l_suppkey % 3 <> 0)::INT, share DESC, l_suppkey) - 1 AS position FROM b
""")
def search_ranked(spark, d):
    """[Q3] Suppliers whose best area says "#4"; a third of them is met by name as well."""
    by_name = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("area"), F.lit("name"))).otherwise(F.array(F.lit("area")))
    hits = search.best_area(areas(spark, d), "l_suppkey", ["#4"]).withColumn("fields", by_name)
    return search.ranked_hits(hits, "l_suppkey").select("l_suppkey", "area", "position")


@query("""
WITH g AS (SELECT o_custkey, count(*) - 8 AS groups FROM orders GROUP BY 1)
SELECT c_custkey, n_name AS institution, groups FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN g ON o_custkey = c_custkey
WHERE lower(c_mktsegment) = 'building' AND groups > 0 AND regexp_matches(lower(c_name), '(^|[^a-z0-9])cus')
""")
def search_directory(spark, d):
    """[Q10] A query, a subject and those with a group."""
    groups = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") - 8).alias("groups"))
    ok, _ = search.matches(search.parsed("이름:cus"), {"name": F.col("name")})
    nations = table(spark, d, "nation").select(F.lower("n_name").alias("current"), F.col("n_name").alias("institution"))
    hits = texts(spark, d).where(ok).join(nations, "current").join(groups, "c_custkey", "left")
    return search.directory(hits, subject="building", connected=True).select("c_custkey", "institution", "groups")


@query("""
WITH e AS (SELECT embedding FROM embeddings WHERE vec_id IN (7, 1, 0, 10) UNION ALL SELECT embedding FROM embeddings WHERE vec_id = 1),
p AS (SELECT unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM e), s AS (SELECT i, sum(v) AS v FROM p GROUP BY i)
SELECT i, round(v / sqrt((SELECT sum(v * v) FROM s)), 6) AS v, (SELECT count(*) FROM e) AS found FROM s
""")
def search_query_vector(spark, d):
    """[Q7] An equal word, a plural, and a beginning that no word equals: of the words that begin with it the first three."""
    words = table(spark, d, "embeddings").select(F.concat(F.lit("word"), F.col("vec_id").cast("string")).alias("term"), F.col("embedding").alias("vector"))
    one = search.query_vector(words, ["word7", "word1s", "word", "wo"])
    return one.select(F.posexplode("vector").alias("i", "v"), "found").select(F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"), F.col("found").cast("long").alias("found"))


@query("""
SELECT event_id FROM events WHERE (event_type = 'click' OR value > 50) AND (CASE user_id % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'review' WHEN 2 THEN 'dataset' WHEN 3 THEN 'letter' ELSE 'book' END) IN ('article', 'review', 'letter', 'editorial') AND event_id % 4 <> 0
""")
def gate_lead_role(spark, d):
    """Events as works: a click is a first authorship, a large value a corresponding one."""
    kind = F.element_at(F.array(*map(F.lit, ("article", "review", "dataset", "letter", "book"))), (F.col("user_id") % 5 + 1).cast("int"))
    first = F.when(F.col("event_type") == "click", "first").otherwise("last")
    source = F.when(F.col("event_id") % 4 == 0, "conference").otherwise("journal")
    return table(spark, d, "events").where(gates.lead_role(first, F.col("value") > 50, kind, source)).select("event_id")


@query("SELECT o_orderkey, year(o_orderdate)::BIGINT AS year FROM orders WHERE year(o_orderdate) + 3 <= 2000")
def gate_closed_window(spark, d):
    """Orders whose three years have passed by the last complete one."""
    rows = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    return rows.where(gates.closed_window(F.col("year"), 3, 2000))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey = 3")
def gate_scope(spark, d):
    """Customers of a segment, and the selected one whatever its segment."""
    return table(spark, d, "customer").where(gates.in_scope(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey"), 3)).select("c_custkey", "c_mktsegment")


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS node, o_orderkey % 4 AS hop FROM orders), l AS (SELECT DISTINCT c_custkey AS node FROM customer WHERE c_acctbal > 2000)
SELECT hop, count(*) AS n, round(avg((l.node IS NOT NULL)::INT), 6) AS logged FROM r LEFT JOIN l ON r.node = l.node GROUP BY hop
""")
def graph_coverage(spark, d):
    """[G5] Share of the nodes at each depth that the ledger has."""
    reached = table(spark, d, "orders").select(F.col("o_custkey").alias("node"), (F.col("o_orderkey") % 4).alias("hop")).distinct()
    return graph.coverage(reached, table(spark, d, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("node")))


@query("""
WITH n AS (SELECT n_nationkey, lower(n_name) AS x FROM nation), k AS (SELECT n_nationkey, regexp_replace(x, '[^a-z0-9]+', '', 'g') AS k, x FROM n)
SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM k a JOIN k b ON a.n_nationkey % 5 = b.n_nationkey % 5 WHERE a.k = b.k OR (length(a.k) >= 4 AND length(b.k) >= 4 AND (contains(a.k, b.k) OR contains(b.k, a.k)))
""")
def text_same_institution(spark, d):
    """[X6] Names of one block that are one institution: "University of X (Y)" and "x college" differ in shared words alone."""
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("block"), F.lower("n_name").alias("name"))
    a = n.select(F.col("n_nationkey").alias("a"), "block", F.concat(F.lit("The University of "), F.col("name"), F.lit(" (Main)")).alias("x"))
    b = n.select(F.col("n_nationkey").alias("b"), "block", F.concat(F.col("name"), F.lit(" College")).alias("y"))
    return a.join(b, "block").where(text.same_institution(F.col("x"), F.col("y"))).select("a", "b")


@query("SELECT n_nationkey, n_name || ' is ' || n_name AS text FROM nation")
def text_from_inverted(spark, d):
    """[X16] Words with their places, back to the text."""
    index = F.map_from_arrays(F.array("n_name", F.lit("is")), F.array(F.array(F.lit(2), F.lit(0)), F.array(F.lit(1))))
    return table(spark, d, "nation").select("n_nationkey", text.inverted_to_text(index).alias("text"))
