"""Flow diagrams over region, nation and market segment; movements of suppliers between part brands; the guarded SQL console."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import flows
from lodestone.plans.registry import query
from lodestone.sources.tables import table

STAGES, REGIONS = ["first", "second", "last"], ["r1", "r2", "r3"]
_PEOPLE = """
WITH people AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE n_name END AS first, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS second,
 CASE WHEN c_custkey % 4 = 0 THEN n_name ELSE r_name END AS last, CASE WHEN n_regionkey = 0 THEN 'domestic' ELSE r_name END AS r1, CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'domestic' END AS r2, 'domestic' AS r3
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
complete AS (SELECT * FROM people WHERE first IS NOT NULL AND second IS NOT NULL AND last IS NOT NULL)
"""


def people(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.when(k % 11 != 0, F.col("n_name")).alias("first"), F.when(k % 13 != 0, F.col("c_mktsegment")).alias("second"), F.when(k % 4 == 0, F.col("n_name")).otherwise(F.col("r_name")).alias("last"),
        F.when(F.col("n_regionkey") == 0, "domestic").otherwise(F.col("r_name")).alias("r1"), F.when(F.col("c_acctbal") < 0, "unknown").otherwise("domestic").alias("r2"), F.lit("domestic").alias("r3"),
    )


@query(_PEOPLE + """
SELECT stage, key, count(*) AS n, CASE WHEN min(region) = max(region) THEN min(region) ELSE 'unknown' END AS region FROM (
 SELECT 'first' AS stage, first AS key, r1 AS region FROM complete UNION ALL SELECT 'second', second, r2 FROM complete UNION ALL SELECT 'last', last, r3 FROM complete) GROUP BY 1, 2
""")
def flow_nodes(spark, d):
    """[A17, C14, C19]"""
    return flows.nodes(flows.complete(people(spark, d), STAGES), "id", STAGES, REGIONS)


@query(_PEOPLE + """
SELECT step, source, target, origin, self_hire, count(*) AS n FROM (SELECT 0::BIGINT AS step, first AS source, second AS target, first AS origin, first = last AS self_hire FROM complete
 UNION ALL SELECT 1, second, last, first, first = last FROM complete) GROUP BY ALL
""")
def flow_links(spark, d):
    """[A17]"""
    return flows.links(flows.complete(people(spark, d), STAGES), STAGES, "first")


@query(_PEOPLE + "SELECT first, second, last, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM complete GROUP BY 1, 2, 3")
def flow_routes(spark, d):
    """[A17, C18]"""
    out = flows.routes(flows.complete(people(spark, d), STAGES), "id", STAGES, members=True)
    return out.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query(_PEOPLE + "SELECT first, second, last, count(*) AS n FROM complete WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1, 2, 3")
def flow_restricted_routes(spark, d):
    """[A44, F26]"""
    chosen = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))
    return flows.restricted_routes(flows.complete(people(spark, d), STAGES), chosen, "id", STAGES)


@query(_PEOPLE + "SELECT stage, key, count(*) AS n FROM (SELECT 'first' AS stage, first AS key FROM people UNION ALL SELECT 'second', second FROM people UNION ALL SELECT 'last', last FROM people) WHERE key IS NOT NULL GROUP BY 1, 2")
def flow_options(spark, d):
    """[A18]"""
    return flows.options(people(spark, d), "id", STAGES)


@query(_PEOPLE + """
SELECT count(*) AS n, sum((first IS NULL OR second IS NULL OR last IS NULL)::INT)::BIGINT AS incomplete, sum((first IS NULL)::INT)::BIGINT AS missing_first, sum((second IS NULL)::INT)::BIGINT AS missing_second, sum((last IS NULL)::INT)::BIGINT AS missing_last FROM people
""")
def flow_missing(spark, d):
    """[A16, C17]"""
    return flows.missing_by_stage(people(spark, d), STAGES)


@query(_PEOPLE + "SELECT CASE WHEN r1 IN ('domestic', 'unknown') THEN first ELSE 'region:' || r1 END AS key, count(*) AS n FROM complete GROUP BY 1")
def flow_grouped_abroad(spark, d):
    """[A17, X9]"""
    p = flows.complete(people(spark, d), STAGES)
    return p.groupBy(flows.grouped_abroad(F.col("first"), F.col("r1")).alias("key")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS unit, year(o_orderdate)::BIGINT AS year FROM orders),
st AS (SELECT o_custkey, year, count(*) AS k, bool_or(unit IS NULL) AS open FROM r GROUP BY 1, 2),
ys AS (SELECT a.year, b.year IS NOT NULL AS comparable FROM (SELECT DISTINCT year FROM r) a LEFT JOIN (SELECT DISTINCT year FROM r) b ON b.year = a.year - 1),
kn AS (SELECT * FROM r WHERE unit IS NOT NULL),
pr AS (SELECT o_custkey, unit, year, bool_or(now) AS now, bool_or(NOT now) AS was FROM (SELECT *, true AS now FROM kn UNION ALL SELECT o_custkey, unit, year + 1, false FROM kn) GROUP BY 1, 2, 3),
f AS (SELECT pr.*, h.k AS k1, h.open AS o1, t.k AS k0, t.open AS o0, comparable AS c FROM pr JOIN ys USING (year) LEFT JOIN st h ON h.o_custkey = pr.o_custkey AND h.year = pr.year LEFT JOIN st t ON t.o_custkey = pr.o_custkey AND t.year + 1 = pr.year),
v AS (SELECT *, coalesce(k1 <> 1 OR k0 <> 1 OR o1 OR o0, false) AS vague FROM f)
SELECT unit, year, sum(now::INT)::BIGINT AS n, bool_or(c) AS comparable, sum(CASE WHEN c THEN was::INT END)::BIGINT AS previous, sum(CASE WHEN c THEN (now AND was)::INT END)::BIGINT AS retained,
 sum(CASE WHEN c THEN (now AND NOT was)::INT END)::BIGINT AS added, sum(CASE WHEN c THEN (was AND NOT now)::INT END)::BIGINT AS removed,
 sum(CASE WHEN c THEN (now AND NOT was AND k0 IS NULL)::INT END)::BIGINT AS prior_unobserved, sum(CASE WHEN c THEN (now AND NOT was AND k0 IS NOT NULL AND vague)::INT END)::BIGINT AS ambiguous_in,
 sum(CASE WHEN c THEN (now AND NOT was AND k0 IS NOT NULL AND NOT vague)::INT END)::BIGINT AS moves_in, sum(CASE WHEN c THEN (was AND NOT now AND k1 IS NULL)::INT END)::BIGINT AS next_unobserved,
 sum(CASE WHEN c THEN (was AND NOT now AND k1 IS NOT NULL AND vague)::INT END)::BIGINT AS ambiguous_out, sum(CASE WHEN c THEN (was AND NOT now AND k1 IS NOT NULL AND NOT vague)::INT END)::BIGINT AS moves_out
FROM v GROUP BY 1, 2
""")
def flow_movements(spark, d):
    """[W5, J21, U3, C14, C16, C20] Year-over-year movements of customers between priorities."""
    r = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("unit"), F.year("o_orderdate").cast("long").alias("year"))
    return flows.movements(r, "o_custkey", "unit", "year")


@query("SELECT DISTINCT o_custkey AS professor_id FROM orders WHERE o_totalprice > 300000")
def console_select(spark, d):
    """A user's statement, guarded, with its result checked. All of its rows: the limit is that of a reader's screen."""
    from lodestone.plans import console

    known = table(spark, d, "customer").select(F.col("c_custkey").alias("professor_id"))
    views = {"orders": table(spark, d, "orders")}
    return console.run(spark, "SELECT o_custkey AS Professor_ID -- who\nFROM orders WHERE o_totalprice > 300000;", views, known, most=None)[0]
