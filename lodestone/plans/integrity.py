"""Checks and mutations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import integrity
from lodestone.plans.registry import query
from lodestone.sources.tables import table


@query("SELECT o_custkey, count(*) AS n, min(y) AS first, max(y) AS last FROM (SELECT DISTINCT o_custkey, year(o_orderdate)::BIGINT AS y FROM orders) GROUP BY 1 HAVING count(*) <> max(y) - min(y) + 1")
def check_year_gaps(spark, d):
    """[V1]"""
    return integrity.year_gaps(table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("y")).distinct(), ["o_custkey"], "y")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_duplicates(spark, d):
    """[V3]"""
    return integrity.duplicates(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line")), ["l_orderkey", "line"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def check_orphans(spark, d):
    """[V3]"""
    rows = integrity.orphans(table(spark, d, "lineitem").select("l_orderkey"), table(spark, d, "orders").where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
SELECT 'discount' AS rule, sum((l_discount > 0.09)::INT)::BIGINT AS n FROM lineitem UNION ALL SELECT 'flag', sum((l_returnflag NOT IN ('A', 'N'))::INT)::BIGINT FROM lineitem UNION ALL SELECT 'quantity', sum((l_quantity > 49)::INT)::BIGINT FROM lineitem
""")
def check_rules(spark, d):
    """[V1, V3, X31]"""
    return integrity.unlike(table(spark, d, "lineitem"), {"discount": F.col("l_discount") <= 0.09, "flag": F.col("l_returnflag").isin("A", "N"), "quantity": F.col("l_quantity") <= 49})


@query("SELECT coalesce(a, b) AS id, CASE WHEN b IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT c_custkey AS a FROM customer WHERE c_acctbal >= 0) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_totalprice > 200000) ON a = b WHERE a IS NULL OR b IS NULL")
def check_same_ids(spark, d):
    """[U4, J20]"""
    return integrity.same_ids(table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")), "id")


@query("""
WITH b AS (SELECT o_custkey AS id, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderstatus) AS status FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1),
n AS (SELECT o_custkey AS id, min(o_totalprice) AS low, max(o_totalprice) AS high, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderstatus) END AS status FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1)
SELECT coalesce(b.id, n.id) AS id, least(b.low, n.low) AS low, greatest(b.high, n.high) AS high, coalesce(n.status, b.status) AS status FROM b FULL JOIN n ON b.id = n.id
""")
def mutate_upsert(spark, d):
    """[V4, G4]"""
    o = table(spark, d, "orders")
    of = lambda rows, status: rows.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), status.alias("status"))
    base, new = of(o.where("year(o_orderdate) < 1998"), F.min("o_orderstatus")), of(o.where("year(o_orderdate) >= 1998"), F.max("o_orderstatus"))
    return integrity.upserted(base, new.withColumn("status", F.when(F.col("id") % 2 == 0, F.col("status"))), ["id"], {"low": "min", "high": "max", "status": "new"})


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def check_conflicts(spark, d):
    """[V6, J19, A42]"""
    return integrity.conflicts(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def mutate_quarantine(spark, d):
    """[V9]"""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    return integrity.quarantined(l, l.where("l_returnflag = 'R'"), ["l_orderkey"])[0].select("l_orderkey")


@query("""
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS l_linestatus,
 concat_ws(',', CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' END, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'l_linestatus' END) AS conflict FROM lineitem GROUP BY 1
""")
def mutate_agreed(spark, d):
    """[V7]"""
    return integrity.agreed(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


_R = "SELECT user_id * 100 + event_id % 50 AS link, user_id AS owner, event_id % 50 AS item, date_trunc('day', ts) AS t, CASE event_id % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'verified' ELSE 'candidate' END AS status FROM events"


def reviews(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "rejected").when(F.col("event_id") % 3 == 1, "verified").otherwise("candidate")
    return e.select((F.col("user_id") * 100 + F.col("event_id") % 50).alias("link"), F.col("user_id").alias("owner"), (F.col("event_id") % 50).alias("item"), F.date_trunc("day", "ts").alias("t"), status.alias("status"))


@query(f"WITH r AS ({_R}) SELECT link, status FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY t DESC, CASE status WHEN 'rejected' THEN 2 WHEN 'verified' THEN 1 ELSE 0 END DESC) AS n FROM r) WHERE n = 1")
def review_states(spark, d):
    """[V12, V8]"""
    return integrity.review_state(reviews(spark, d), "link", "t", "status")


@query(f"WITH r AS ({_R}) SELECT item, count(DISTINCT owner) AS owners, count(*) AS n FROM r WHERE status = 'verified' GROUP BY 1 HAVING count(DISTINCT owner) > 1")
def review_competing(spark, d):
    """[V12]"""
    return integrity.competing(reviews(spark, d), "item", "owner", "status")


@query("""
WITH p AS (SELECT o_custkey, count(*) AS n, max(year(o_orderdate)) AS award FROM orders WHERE o_totalprice > 350000 GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey, o.o_custkey FROM orders o JOIN p USING (o_custkey) WHERE abs(year(o_orderdate) - award) <= 1
""")
def join_year_tolerance(spark, d):
    """[J25, J28]"""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    people = o.where("o_totalprice > 350000").select("o_custkey", F.col("y").alias("award"))
    return integrity.linked_by_parent(o, people, "o_custkey", "y", "award").select("o_orderkey", "o_custkey")
