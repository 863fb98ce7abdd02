"""Islands, spells and as-of lookups over orders, shipments and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.periods import half_of, period_of, year_label
from lodestone.operators import intervals
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_HALF = "(year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END)::BIGINT"


def halves(spark, d):
    return table(spark, d, "orders").select("o_custkey", half_of(F.col("o_orderdate")).alias("at"))


def spells(spark, d):
    """Each order is a spell of its customer: from its half-year on, two to four half-years."""
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", half_of(F.col("o_orderdate")).alias("s")).withColumn("e", F.col("s") + F.col("o_orderkey") % 3)


_SPELLS = f"SELECT o_custkey, o_orderstatus, o_orderkey, {_HALF} AS s, {_HALF} + o_orderkey % 3 AS e FROM orders"
_ISLANDS = f"""
WITH p AS (SELECT DISTINCT o_custkey, {_HALF} AS t FROM orders), g AS (SELECT *, t - row_number() OVER (PARTITION BY o_custkey ORDER BY t) AS k FROM p)
"""


@query(_ISLANDS + 'SELECT o_custkey, min(t) AS start, max(t) AS "end", count(*) AS n FROM g GROUP BY o_custkey, k')
def interval_islands(spark, d):
    """[W1, W3, X13]"""
    return intervals.islands(halves(spark, d), ["o_custkey"], "at")


@query(f"""
WITH p AS ({_SPELLS}), f AS (SELECT *, CASE WHEN s <= max(e) OVER w + 3 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY s, e, o_orderkey) AS run FROM f)
SELECT o_custkey, o_orderstatus, min(s) AS s, max(e) AS e, count(*) AS n FROM r GROUP BY o_custkey, o_orderstatus, run
""")
def interval_merge(spark, d):
    """[W2] At most two missing half-years between."""
    return intervals.merged(spells(spark, d), ["o_custkey", "o_orderstatus"], "s", "e", 3, [F.count("*").alias("n")], ["o_orderkey"])


@query(f"""
WITH p AS ({_SPELLS}), u AS (SELECT o_custkey, o_orderkey, unnest(generate_series(s, e)) AS t FROM p WHERE o_orderstatus = 'O'),
l AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.o_custkey = u.o_custkey AND p.o_orderstatus = 'F' AND p.s = u.t)),
g AS (SELECT *, t - row_number() OVER (PARTITION BY o_orderkey ORDER BY t) AS k FROM l)
SELECT o_orderkey, min(t) AS s, max(t) AS e FROM g GROUP BY o_orderkey, k
""")
def interval_subtract(spark, d):
    """[W4] Observed half-years taken out of inferred spells."""
    s = spells(spark, d)
    return intervals.subtracted(s.where("o_orderstatus = 'O'"), s.where("o_orderstatus = 'F'").withColumnRenamed("s", "at"), ["o_orderkey"], ["o_custkey"], "s", "e")


@query(f"""
WITH p AS ({_SPELLS}), l AS (SELECT o_custkey, o_orderkey, s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE e END AS e FROM p WHERE o_orderstatus = 'F')
SELECT p.o_orderkey, l.o_orderkey AS holder FROM p JOIN l ON p.o_custkey = l.o_custkey AND p.s >= l.s AND (l.e IS NULL OR p.s <= l.e)
""")
def interval_covering(spark, d):
    """[J7, F10] Points in spells of the same key, open ends included."""
    p = spells(spark, d)
    holders = p.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("holder"), F.col("s").alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("e")).alias("b"))
    return intervals.covering(p.select("o_custkey", "o_orderkey", "s"), holders, ["o_custkey"], "s", "a", "b").select("o_orderkey", "holder")


@query("""
WITH p AS (SELECT DISTINCT l_suppkey, l_partkey AS unit, (year(l_shipdate) * 2 + CASE WHEN month(l_shipdate) > 6 THEN 1 ELSE 0 END)::BIGINT AS s FROM lineitem),
r AS (SELECT *, s + l_suppkey % 3 AS e FROM p)
SELECT a.unit, a.l_suppkey AS l_suppkey_a, b.l_suppkey AS l_suppkey_b, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM r a JOIN r b ON a.unit = b.unit AND a.l_suppkey < b.l_suppkey AND greatest(a.s, b.s) <= least(a.e, b.e)
""")
def interval_overlaps(spark, d):
    """[J8, J9, C13] Overlapping spells at a unit."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("unit"), half_of(F.col("l_shipdate")).alias("s")).distinct()
    return intervals.overlaps(rows.withColumn("e", F.col("s") + F.col("l_suppkey") % 3), ["unit"], "l_suppkey", "s", "e")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, year(o_orderdate)::BIGINT AS a, year(o_orderdate)::BIGINT + o_orderkey % 2 AS b FROM orders WHERE o_orderpriority = '1-URGENT'),
p AS (SELECT DISTINCT o_custkey, year(o_orderdate)::BIGINT AS y FROM orders),
j AS (SELECT p.o_custkey, p.y, s.o_orderkey, CASE WHEN a <= y AND b >= y THEN 2 WHEN a <= y THEN 1 ELSE 0 END AS r, CASE WHEN a <= y THEN a ELSE -a END AS k FROM p JOIN s USING (o_custkey))
SELECT o_custkey, y, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY r DESC, k DESC, o_orderkey DESC) AS rn FROM j) WHERE rn = 1
""")
def interval_as_of(spark, d):
    """[R6]"""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.year("o_orderdate").cast("long").alias("y"))
    s = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", F.col("y").alias("a"), (F.col("y") + F.col("o_orderkey") % 2).alias("b"))
    return intervals.as_of(o.select("o_custkey", "y").distinct(), s, ["o_custkey"], "y", "a", "b", "o_orderkey")


@query(f"""
WITH p AS ({_SPELLS})
SELECT o_orderkey, s, least(e, 3995) AS e, 'former' AS name FROM p WHERE s < 3996 UNION ALL SELECT o_orderkey, greatest(s, 3996), e, 'successor' FROM p WHERE e >= 3996
""")
def interval_split(spark, d):
    """[W19, X30] A succession splits spells at its date."""
    out = intervals.split_at(spells(spark, d), "s", "e", 3996, "name", F.lit("former"), F.lit("successor"))
    return out.select("o_orderkey", "s", "e", "name")


@query("""
WITH s AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'faculty' WHEN o_orderstatus = 'O' THEN 'postdoc' ELSE 'doctoral' END AS stage, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS p, year(o_orderdate) AS a FROM orders),
y AS (SELECT c_custkey, unnest([1996, 1998, 2000])::BIGINT AS y FROM customer)
SELECT c_custkey AS o_custkey, y.y, coalesce(arg_max(stage, p) FILTER (WHERE a <= y AND a + 1 >= y), 'none') AS stage FROM y LEFT JOIN s ON s.o_custkey = c_custkey GROUP BY 1, 2
""")
def interval_stage_of_year(spark, d):
    """[W9]"""
    stage = F.when(F.col("o_orderstatus") == "F", "faculty").when(F.col("o_orderstatus") == "O", "postdoc").otherwise("doctoral")
    s = table(spark, d, "orders").select("o_custkey", stage.alias("stage"), F.year("o_orderdate").cast("long").alias("a")).withColumn("b", F.col("a") + 1)
    years = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(*(F.lit(x).cast("long") for x in (1996, 1998, 2000)))).alias("y"))
    priority = F.when(F.col("stage") == "faculty", 3).when(F.col("stage") == "postdoc", 2).otherwise(1)
    return intervals.stage_of_year(years, s, ["o_custkey"], "y", "a", "b", priority, F.lit("none"))


@query(_ISLANDS.replace(_HALF, "year(o_orderdate)::BIGINT") + """, r AS (SELECT o_custkey, min(t) AS a, max(t) AS b FROM g GROUP BY o_custkey, k)
SELECT o_custkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '–' || b::VARCHAR END, ', ' ORDER BY a) AS label FROM r GROUP BY 1""")
def interval_year_label(spark, d):
    """[W17]"""
    years = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("years"))
    return years.select("o_custkey", year_label(F.col("years")).alias("label"))


@query(f"""
WITH g AS (SELECT o_custkey, min(year(o_orderdate)) * 2 + 4 AS gate FROM orders GROUP BY 1), p AS ({_SPELLS})
SELECT p.o_orderkey, greatest(s, gate)::BIGINT AS s, e FROM p JOIN g USING (o_custkey) WHERE e >= gate
""")
def interval_clamp(spark, d):
    """[F11]"""
    from lodestone.operators import gates

    p = spells(spark, d)
    gate = p.groupBy("o_custkey").agg((F.floor(F.min("s") / 2) * 2 + 4).alias("gate"))
    return gates.clamped(p.join(gate, "o_custkey"), "s", "e", F.col("gate")).select("o_orderkey", "s", "e")


@query("""
SELECT o_orderkey, printf('%04d-H%d', year(o_orderdate), CASE WHEN month(o_orderdate) > 6 THEN 2 ELSE 1 END) AS period FROM orders
""")
def scalar_periods(spark, d):
    """[X1, X13]"""
    return table(spark, d, "orders").select("o_orderkey", period_of(half_of(F.col("o_orderdate"))).alias("period"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 86400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, session::BIGINT AS session, count(*) AS n, epoch_us(min(ts)) // 1000000 AS start FROM s GROUP BY 1, 2
""")
def interval_sessions(spark, d):
    """[W1, W2] Sessions of events a day apart or less."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    w = Window.partitionBy("user_id").orderBy("u", "event_id")
    new = F.coalesce((F.col("u") - F.lag("u").over(w) > 86_400_000_000).cast("int"), F.lit(1))
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("t").alias("start"))
