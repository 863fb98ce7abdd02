"""Stores with logs: batches of orders, corrections, rollbacks, schemas, and a graph fetched by layers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators.collector import Collector
from lodestone.operators.staging import shared_folder
from lodestone.plans.registry import query
from lodestone.sources.commits import Migration, Store
from lodestone.sources.tables import table


def store(spark, migrations=None) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", migrations)


def batches(spark, d):
    """Orders in three batches by year."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"), F.year("o_orderdate").alias("y"))
    return [o.where(c).drop("y") for c in ("y < 1994", "y between 1994 and 1996", "y > 1996")]


_O = "WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS price, CASE WHEN year(o_orderdate) < 1994 THEN 1 WHEN year(o_orderdate) <= 1996 THEN 2 ELSE 3 END AS b FROM orders) "


@query(_O + "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN price / 2 ELSE price END AS price, CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE b END::BIGINT AS \"commit\" FROM o")
def commit_overlay(spark, d):
    """[V5, V10] Batches, one of them twice, one that a check refuses, then corrections over all of them."""
    s = store(spark)
    first, second, third = batches(spark, d)
    ok = {"price": F.col("price") > 0, "key": F.col("o_orderkey").isNotNull()}
    for rows in (first, second, first.orderBy(F.desc("o_orderkey")), third, second):
        s.append(rows, ok)
    try:
        s.append(third.withColumn("price", -F.col("price")), ok)
    except ValueError:
        pass  # nothing of it is there
    over = s.read().where("o_orderkey % 7 = 0").select("o_orderkey", "o_custkey", (F.col("price") / 2).alias("price"))
    s.overlay(over, ok)
    return s.current(["o_orderkey"]).withColumnRenamed("_commit", "commit")


@query(_O + "SELECT o_orderkey, o_custkey, price, b::BIGINT AS \"commit\" FROM o WHERE b < 3")
def commit_rollback(spark, d):
    """[V5] Back to the version of the second commit, the third undone."""
    s = store(spark)
    for rows in batches(spark, d):
        s.append(rows)
    s.rollback(2)
    return s.read().withColumnRenamed("_commit", "commit")


STEPS = [
    Migration(2, {"order_id": "o_orderkey", "customer_id": "o_custkey", "price": "price"}, ["order_id"], ["o_orderkey"]),
    Migration(3, {"order_id": "order_id", "customer_id": "customer_id", "cents": "cast(round(price * 100) as bigint)", "large": "price > 100000"}, ["order_id"]),
]


@query(_O + "SELECT o_orderkey AS order_id, o_custkey AS customer_id, round(price * 100)::BIGINT AS cents, price > 100000 AS large FROM o")
def commit_migration(spark, d):
    """[V11] Two batches in the first schema, one in the third; all read in the third."""
    s = store(spark, STEPS)
    first, second, third = batches(spark, d)
    s.append(first)
    s.append(second)
    s.migrate(3)
    s.append(third.selectExpr("o_orderkey as order_id", "o_custkey as customer_id", "cast(round(price * 100) as bigint) as cents", "price > 100000 as large"))
    return s.read().drop("_commit")


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % 1000 AS dst FROM orders), l1 AS (SELECT c_custkey AS node FROM customer WHERE c_nationkey = 3),
l2 AS (SELECT DISTINCT dst AS node FROM l1 JOIN e ON src = node WHERE node % 50 <> 7 AND dst NOT IN (SELECT node FROM l1)), n AS (SELECT src, count(*) AS n FROM e GROUP BY 1),
a AS (SELECT node, 1 AS layer FROM l1 UNION ALL SELECT node, 2 FROM l2)
SELECT node, layer, CASE WHEN node % 50 = 7 THEN 'lost' WHEN n IS NULL THEN 'missing' ELSE 'complete' END AS status, CASE WHEN node % 50 = 7 THEN 2 ELSE 1 END::BIGINT AS tries, CASE WHEN node % 50 <> 7 THEN coalesce(n, 0) END AS n FROM a LEFT JOIN n ON src = node
""")
def collect_layers(spark, d):
    """[S8] Two layers from the customers of a nation, stopped after two batches and resumed; nodes that never answer are given up."""
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % 1000).alias("dst")).distinct()
    seeds = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("node"))
    quiet = lambda node: node % 50 == 7

    def collector(edges=store(spark), ledger=store(spark)) -> Collector:
        return Collector(edges, ledger, lambda nodes: e.join(nodes, F.col("src") == F.col("node")).select("src", "dst"), size=50, tries=2, failed=quiet)

    collector().run(seeds, 2, most=2)
    last = collector()
    last.run(seeds, 2)
    return last.states(seeds, 2)
