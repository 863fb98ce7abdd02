"""Search over customers, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.plans.registry import query
from lodestone.sources.tables import table


def texts(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.lower("c_name").alias("name"), F.lower("n_name").alias("current"), F.lower("r_name").alias("phd"), F.lower("c_mktsegment").alias("subject"))


@query("""
WITH t AS (SELECT c_custkey, lower(c_name) AS name, lower(n_name) AS current, lower(r_name) AS phd, lower(c_mktsegment) AS subject FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(current, '(^|[^a-z0-9])a') THEN 'current' END, CASE WHEN regexp_matches(name, '(^|[^a-z0-9])a') THEN 'name' END,
 CASE WHEN regexp_matches(phd, '(^|[^a-z0-9])a') THEN 'phd' END, 'subject'], lambda x: x IS NOT NULL)), ',') AS fields
FROM t WHERE contains(subject, 'build') AND (regexp_matches(name, '(^|[^a-z0-9])a') OR regexp_matches(current, '(^|[^a-z0-9])a') OR regexp_matches(phd, '(^|[^a-z0-9])a') OR regexp_matches(subject, '(^|[^a-z0-9])a'))
""")
def search_scoped(spark, d):
    """[Q1, Q2, X23, X24]"""
    t = texts(spark, d)
    ok, fields = search.matches(search.parsed('field:"build" a'), {f: F.col(f) for f in ("name", "current", "phd", "subject")})
    return t.where(ok).select("c_custkey", F.array_join(fields, ",").alias("fields"))


@query("""
SELECT p_partkey, greatest(CASE WHEN lower(p_type) = 'x' THEN 100 WHEN starts_with(lower(p_name), 'red w') THEN 80 WHEN contains(lower(p_name), 'red w') THEN 60 ELSE 0 END, CASE WHEN contains(lower(p_brand), 'red w') THEN 40 ELSE 0 END, 0)::INTEGER AS score
FROM part WHERE contains(lower(p_name), 'red w') OR contains(lower(p_brand), 'red w') ORDER BY score DESC, p_partkey LIMIT 8
""")
def search_lookup(spark, d):
    """[Q5, R3] The eight best."""
    p = table(spark, d, "part")
    score = search.lookup_score("red w", F.col("p_name"), F.lit(""), {40: F.col("p_brand")})
    return p.select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(8)


_AREAS = """
WITH n AS (SELECT l_suppkey, p_brand AS area, (p_size % 3)::BIGINT AS level, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), a AS (SELECT l_suppkey, area, level, round(n / sum(n) OVER (PARTITION BY l_suppkey), 6) AS share FROM n)
"""


def areas(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("area"), (F.col("p_size") % 3).cast("long").alias("level"))
    n = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(p, "l_partkey").groupBy("l_suppkey", "area", "level").agg(F.count("*").alias("n"))
    return n.select("l_suppkey", "area", "level", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey")), 6).alias("share"))


@query(_AREAS + "SELECT l_suppkey, area, level, share FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY share DESC, level DESC, area) AS r FROM a WHERE contains(lower(area), '#4')) WHERE r = 1")
def search_best_area(spark, d):
    """[Q3, Q4]"""
    return search.best_area(areas(spark, d), "l_suppkey", ["#4"])


@query("""
SELECT vec_id, round(0.55 * greatest(0, list_cosine_similarity(embedding::DOUBLE[], (SELECT list_transform(range(len(embedding)), lambda i: CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END) FROM embeddings LIMIT 1)::DOUBLE[])) + 0.45 * (CASE WHEN label = 3 THEN 1.0 WHEN label BETWEEN 30 AND 39 THEN 0.8 ELSE 0 END), 6) AS score
FROM embeddings WHERE 0.55 * greatest(0, list_cosine_similarity(embedding::DOUBLE[], (SELECT list_transform(range(len(embedding)), lambda i: CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END) FROM embeddings LIMIT 1)::DOUBLE[])) + 0.45 * (CASE WHEN label = 3 THEN 1.0 ELSE 0 END) >= 0.22
""")
def search_topics(spark, d):
    """[Q6, Q7] Vector and tags together."""
    e = table(spark, d, "embeddings").withColumn("tags", F.array(F.concat(F.lit("t"), F.col("label").cast("string"))))
    q = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
    return search.topic_scores(e, "embedding", "tags", q, ["t3"]).select("vec_id", F.round("score", 6).alias("score"))


@query(_AREAS + """
, h AS (SELECT DISTINCT l_suppkey, area FROM a WHERE share >= 0.03) SELECT l.l_suppkey, p_brand AS area, year(l_shipdate)::BIGINT AS year, count(*) AS n FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN h ON h.l_suppkey = l.l_suppkey AND h.area = p_brand GROUP BY 1, 2, 3
""")
def search_series(spark, d):
    """[Q9]"""
    works = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").cast("long").alias("year")).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("area")), "l_partkey")
    return search.series(areas(spark, d).where("share >= 0.03"), works, ["l_suppkey", "area"], "year")


@query(_AREAS + """
, m AS (SELECT s_suppkey AS l_suppkey FROM supplier WHERE s_acctbal > 5000), h AS (SELECT DISTINCT l_suppkey, area FROM a WHERE share >= 0.03),
t AS (SELECT l_suppkey, area, count(*) AS n FROM lineitem JOIN (SELECT p_partkey, p_brand AS area FROM part) ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l_suppkey, area AS topic FROM h WHERE l_suppkey IN (SELECT * FROM m)
UNION ALL SELECT l_suppkey, area FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, area DESC) AS r FROM t WHERE area <> 'Other') WHERE r = 1 AND l_suppkey IN (SELECT * FROM m) AND l_suppkey NOT IN (SELECT l_suppkey FROM h)
""")
def search_curated(spark, d):
    """[Q8, Q10]"""
    members = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    hits = areas(spark, d).where("share >= 0.03").select("l_suppkey", F.col("area").alias("topic")).distinct()
    topics = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic")), "l_partkey").groupBy("l_suppkey", "topic").agg(F.count("*").alias("n"))
    return search.within_group(hits, members, topics, "l_suppkey")


@query("""
WITH g AS (SELECT '분야' || (p_partkey % 40) AS word, unnest([lower(p_brand), p_type]) AS mean FROM part UNION ALL SELECT '분야', 'field'), q AS (SELECT unnest(['분야7', '야3', 'steel', '큰 분야9 말']) AS t),
near AS (SELECT t, word, mean, max((t = word)::INT) OVER (PARTITION BY t) AS any_equal FROM q JOIN g ON regexp_matches(t, '[가-힣]') AND (contains(word, t) OR contains(t, word))),
m AS (SELECT mean AS term FROM near WHERE any_equal = 0 OR t = word UNION SELECT t FROM q WHERE NOT regexp_matches(t, '[가-힣]'))
SELECT term FROM m UNION SELECT unnest(string_split_regex(term, '\\s+')) FROM m
""")
def search_expanded(spark, d):
    """[X22] Words in Hangul by a glossary of parts: an equal word, words that hold the term, words that the term holds."""
    p = table(spark, d, "part")
    glossary = p.select(F.concat(F.lit("분야"), F.col("p_partkey") % 40).alias("word"), F.array(F.lower("p_brand"), "p_type").alias("means"))
    glossary = glossary.unionByName(spark.createDataFrame([("분야", ["field"])], "word string, means array<string>"))
    return search.expanded(["분야7", "야3", "steel", "큰 분야9 말"], glossary)
