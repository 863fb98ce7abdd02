"""Careers of customers: orders as evidence, nations and brands as units."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.periods import half_of
from lodestone.operators import career
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_H = "(year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::BIGINT"
_SP = f"SELECT o_custkey AS person, CASE o_orderstatus WHEN 'F' THEN 'faculty' WHEN 'O' THEN 'postdoc' ELSE 'doctoral' END AS stage, o_orderkey % 5 AS unit, {_H} AS s, {_H} + o_orderkey % 3 AS e FROM orders"


def spells(spark, d):
    stage = F.when(F.col("o_orderstatus") == "F", "faculty").when(F.col("o_orderstatus") == "O", "postdoc").otherwise("doctoral")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("person"), stage.alias("stage"), (F.col("o_orderkey") % 5).alias("unit"), half_of(F.col("o_orderdate")).alias("start")).withColumn("end", F.col("start") + F.lit(0).cast("long"))


def orders(spark, d):
    o = table(spark, d, "orders")
    stage = F.when(F.col("o_orderstatus") == "F", "faculty").when(F.col("o_orderstatus") == "O", "postdoc").otherwise("doctoral")
    h = half_of(F.col("o_orderdate"))
    return o.select(F.col("o_custkey").alias("person"), stage.alias("stage"), (F.col("o_orderkey") % 5).alias("unit"), h.alias("start"), (h + F.col("o_orderkey") % 3).alias("end"))


@query(f"""
WITH p AS ({_SP}), o AS (SELECT *, max(e) OVER (PARTITION BY person, stage ORDER BY s, e, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p)
SELECT person, stage, count(*) AS n FROM o WHERE s <= b GROUP BY 1, 2
""")
def career_invalid(spark, d):
    """[C9]"""
    return career.invalid_spells(orders(spark, d)).groupBy("person", "stage").agg(F.count("*").alias("n"))


@query(f"""
WITH p AS ({_SP}), f AS (SELECT person, min(s) AS start FROM p WHERE stage = 'faculty' GROUP BY 1)
SELECT p.person, f.start, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS unit FROM p JOIN f ON p.person = f.person AND p.s = f.start WHERE stage = 'faculty' GROUP BY 1, 2
""")
def career_first_appointment(spark, d):
    """[C10, W6]"""
    return career.first_appointments(orders(spark, d))


@query(f"""
WITH p AS ({_SP}), ego AS (SELECT DISTINCT CASE stage WHEN 'faculty' THEN 'first_faculty' ELSE stage END AS own, unit, unnest(generate_series(s, e)) AS t FROM p WHERE person = 7),
o AS (SELECT DISTINCT person, stage, unit, unnest(generate_series(s, e)) AS t FROM p WHERE person <> 7),
m AS (SELECT DISTINCT person, own, o.unit, o.t FROM o JOIN ego ON o.unit = ego.unit AND o.t = ego.t WHERE (own = 'doctoral' AND stage IN ('doctoral', 'faculty')) OR (own = 'postdoc' AND stage IN ('doctoral', 'postdoc', 'faculty')) OR (own = 'first_faculty' AND stage IN ('doctoral', 'faculty')))
SELECT person, count(*) AS n, round(count(*) / greatest((SELECT count(*) FROM ego), 1), 6) AS share FROM m GROUP BY 1
""")
def career_peers(spark, d):
    """[C12, C13, J8, A38]"""
    s = orders(spark, d)
    ego = s.where("person = 7").withColumn("stage", F.when(F.col("stage") == "faculty", "first_faculty").otherwise(F.col("stage")))
    return career.peers(ego, s.where("person <> 7"))


@query("""
SELECT c_custkey, c_name, k > 1 AS conflict FROM customer JOIN (SELECT c_mktsegment, c_nationkey % 5 AS g, count(DISTINCT CASE WHEN c_acctbal > 9000 THEN c_nationkey END) AS k FROM customer GROUP BY 1, 2) USING (c_mktsegment) WHERE g = c_nationkey % 5
""")
def career_country_conflicts(spark, d):
    """[C14]"""
    c = table(spark, d, "customer").withColumn("school", F.concat_ws("/", "c_mktsegment", (F.col("c_nationkey") % 5).cast("string"))).withColumn("country", F.when(F.col("c_acctbal") > 9000, F.col("c_nationkey")))
    return career.country_conflicts(c, "school", "country").select("c_custkey", "c_name", "conflict")


@query(f"""
WITH p AS (SELECT o_custkey AS person, o_orderkey AS work, o_orderkey % 5 AS unit, o_orderstatus, {_H} AS t FROM orders), q AS (SELECT person, min(t) // 2 AS phd_year FROM p GROUP BY 1), f AS (SELECT person, min(t) AS f FROM p WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT person, unit, min(t) AS start, max(t) AS "end", count(DISTINCT work) AS n FROM p JOIN q USING (person) LEFT JOIN f USING (person) WHERE t > phd_year * 2 + 1 AND (f IS NULL OR t < f) GROUP BY 1, 2 HAVING count(DISTINCT work) >= 2
""")
def career_candidates(spark, d):
    """[C8]"""
    w = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("work"), (F.col("o_orderkey") % 5).alias("unit"), "o_orderstatus", half_of(F.col("o_orderdate")).alias("at"))
    people = w.groupBy("person").agg(F.floor(F.min("at") / 2).alias("phd_year"))
    return career.candidates(w, people, w.where("o_orderstatus = 'P'").withColumn("start", F.col("at")))


@query(f"""
WITH p AS (SELECT o_custkey AS person, o_orderkey % 5 AS unit, {_H} AS t FROM orders), g AS (SELECT person, t // 2 AS year, unit, max(t) AS last, count(DISTINCT t) AS terms FROM p GROUP BY 1, 2, 3)
SELECT person, year, unit, terms, last = max(last) OVER (PARTITION BY person) AS current FROM g
""")
def career_appointments(spark, d):
    """[C7]"""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), (F.col("o_orderkey") % 5).alias("unit"), half_of(F.col("o_orderdate")).alias("at"))
    return career.appointments(o).withColumn("terms", F.size("terms").cast("long"))


@query("""
WITH p AS (SELECT c_custkey AS person, CASE WHEN c_custkey % 3 = 0 THEN 1990 + c_custkey % 20 END AS s, CASE WHEN c_custkey % 2 = 0 THEN 2000 + c_custkey % 5 END AS e, CASE WHEN c_custkey % 7 > 0 THEN 1985 + c_custkey % 30 END AS y FROM customer)
SELECT person, CASE WHEN s <= e THEN s ELSE y - 5 END AS start, CASE WHEN s <= e THEN e ELSE y END AS "end", NOT coalesce(s <= e, false) AND y IS NOT NULL AS estimated, CASE WHEN NOT coalesce(s <= e, false) AND y IS NULL THEN 'no_time' END AS reason FROM p
""")
def career_intervals(spark, d):
    """[C1, C15, A43]"""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("person"), F.when(k % 3 == 0, 1990 + k % 20).alias("start"), F.when(k % 2 == 0, 2000 + k % 5).alias("end"), F.when(k % 7 > 0, 1985 + k % 30).alias("phd_year"))
    return career.intervals_with_coverage(p)


@query()
def career_reconciled(spark, d):
    """[C5, W3, W4]"""
    s = orders(spark, d).withColumn("institution", F.concat(F.lit("U"), F.col("unit").cast("string"))).withColumn("kind", F.when(F.col("stage") == "postdoc", "publication").otherwise("inferred")).withColumn("confidence", F.lit("medium"))
    seen = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("person"), (F.col("o_orderkey") % 5).alias("unit"), F.concat(F.lit("U"), (F.col("o_orderkey") % 5).cast("string")).alias("institution"), half_of(F.col("o_orderdate")).alias("at")).distinct()
    return career.reconciled(s.distinct(), seen)


@query(f"""
WITH p AS ({_SP}), g AS (SELECT DISTINCT person AS ego, CASE stage WHEN 'faculty' THEN 'first_faculty' ELSE stage END AS own, unit, s AS f0, e AS t0 FROM p WHERE person IN (7, 8, 10)),
m AS (SELECT DISTINCT ego, own, g.unit, f0, t0, person, stage, greatest(s, f0) AS f, least(e, t0) AS t FROM g JOIN p ON p.unit = g.unit AND s <= t0 AND e >= f0 AND person <> ego
 AND ((own = 'doctoral' AND stage IN ('doctoral', 'faculty')) OR (own = 'postdoc' AND stage IN ('doctoral', 'postdoc', 'faculty')) OR (own = 'first_faculty' AND stage IN ('doctoral', 'faculty')))),
n AS (SELECT DISTINCT ego, own, unit, f0, t0, person AS node FROM m UNION SELECT DISTINCT ego, own, unit, f0, t0, ego FROM m), k AS (SELECT ego, own, unit, f0, t0, count(*) AS k, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM n GROUP BY ALL),
c AS (SELECT a.ego, a.own, a.unit, a.f0, a.t0, b.own AS own2, b.unit AS unit2, b.f0 AS f02, b.t0 AS t02, count(*) AS s FROM n a JOIN n b ON a.ego = b.ego AND a.node = b.node AND (a.own, a.unit, a.f0, a.t0) <> (b.own, b.unit, b.f0, b.t0) GROUP BY ALL),
r AS (SELECT c.ego, c.own, c.unit, c.f0, c.t0, sum(s / (x.k + y.k - s)) AS red FROM c JOIN k x ON (x.ego, x.own, x.unit, x.f0, x.t0) = (c.ego, c.own, c.unit, c.f0, c.t0) JOIN k y ON (y.ego, y.own, y.unit, y.f0, y.t0) = (c.ego, c.own2, c.unit2, c.f02, c.t02) GROUP BY ALL),
v AS (SELECT ego, own, unit, f0, t0, string_agg(person || ':' || stage || ':' || f || '-' || t || ':' || (t - f + 1), ' ' ORDER BY person, stage, f, t) AS evidence FROM m GROUP BY ALL)
SELECT k.ego, k.own AS stage, k.unit, k.f0 AS start, k.t0 AS "end", members, evidence, round(coalesce(red, 0), 6) AS redundancy, round(k / (k - 1) / (1 + coalesce(red, 0)), 6) AS weight FROM k JOIN v USING (ego, own, unit, f0, t0) LEFT JOIN r USING (ego, own, unit, f0, t0)
""")
def career_ego_hypergraph(spark, d):
    """[G20] Of three people."""
    s = orders(spark, d)
    ego = s.where("person in (7, 8, 10)").select(F.col("person").alias("ego"), F.when(F.col("stage") == "faculty", "first_faculty").otherwise(F.col("stage")).alias("stage"), "unit", "start", "end")
    out = career.ego_hypergraph(ego, s)
    said = F.transform("evidence", lambda e: F.concat_ws(":", e["person"].cast("string"), e["stage"], F.concat_ws("-", e["from"].cast("string"), e["to"].cast("string")), e["years"].cast("string")))
    return out.select("ego", "stage", "unit", "start", "end", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), F.array_join(said, " ").alias("evidence"), F.round("redundancy", 6).alias("redundancy"), F.round("weight", 6).alias("weight"))
