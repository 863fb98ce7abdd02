"""Filters, joins, aggregates, ranks and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import gates, yearly
from lodestone.plans.registry import query
from lodestone.sources.tables import documents, id_batches, last_write, numbered_in, pending, table

year = lambda c: F.year(c).cast("long")


@query("""
SELECT year(o.o_orderdate)::BIGINT AS year, c.c_mktsegment, count(DISTINCT o.o_custkey) AS customers, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 100000 GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT o_orderpriority) >= 2)
GROUP BY 1, 2
""")
def slice_group_threshold(spark: SparkSession, d: str) -> DataFrame:
    """[A1-A3, J1, J4, F1] Customers with enough large orders over enough groups, by year and segment."""
    orders = table(spark, d, "orders")
    fit = orders.where("o_totalprice >= 100000").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("k")).where("n >= 3 and k >= 2")
    rows = gates.restricted(orders, fit, "o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rows.groupBy(year("o_orderdate").alias("year"), "c_mktsegment").agg(F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT c_custkey, c_name, c_nationkey::BIGINT AS nation FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND lower(c_name) LIKE '%00%'
""")
def filter_optional(spark, d):
    """[F1-F3, F14] Parameters, of which some are not given."""
    c = table(spark, d, "customer")
    keep = gates.all_of(gates.optional(F.col("c_mktsegment"), "BUILDING"), gates.optional(F.col("c_nationkey"), None), F.col("c_acctbal") >= 0, gates.holds_text(F.col("c_name"), "00"))
    return c.where(keep).select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("nation"))


_GATE = """
WITH base AS (SELECT d.doc_id, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT doc_id, source, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 0 AND toxic = 1 THEN 'namesake' WHEN quality = 0 THEN 'unresolved'
 WHEN n_chars < 500 THEN 'no_kept_source' WHEN toxic = 1 THEN 'inconsistent' END AS reason FROM base)
"""


def _gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    kept = table(spark, d, "documents").where("n_chars >= 500").select("doc_id")
    labels = table(spark, d, "labels")
    decisions = labels.select("doc_id", F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "namesake_paper").when(F.col("quality") == 0, "unclear").otherwise("true_paper").alias("decision"))
    return docs, decisions, kept, labels.where("toxic = 1").select("doc_id")


@query(_GATE + "SELECT doc_id, source FROM r WHERE reason IS NULL")
def gate_strict_identity(spark, d):
    """[F4, F19, J3-J5]"""
    return gates.strict_identity(*_gate(spark, d), ["doc_id"])


@query(_GATE + "SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1, 2")
def gate_reason_counts(spark, d):
    """[F5, F7, A16, J12]"""
    return gates.identity_reason(*_gate(spark, d), ["doc_id"]).groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.08 THEN 'discount' WHEN l_quantity < 5 THEN 'small' WHEN year(l_shipdate) < 1996 THEN 'early' ELSE 'kept' END AS reason, count(*) AS n
FROM lineitem GROUP BY 1
""")
def cascade_counts(spark, d):
    """[F7, F8] Ordered exclusions, one reason each, with counts."""
    rules = [("returned", F.col("l_returnflag") == "R"), ("discount", F.col("l_discount") > 0.08), ("small", F.col("l_quantity") < 5), ("early", F.year("l_shipdate") < 1996)]
    return gates.reason_counts(gates.cascade(table(spark, d, "lineitem"), rules))


@query("""
WITH f AS (SELECT o_custkey, min(year(o_orderdate)) + 3 AS start FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey FROM orders o LEFT JOIN f ON o.o_custkey = f.o_custkey
WHERE (f.start IS NULL OR year(o.o_orderdate) >= f.start - 1) AND year(o.o_orderdate) <= 2000
""")
def gate_temporal(spark, d):
    """No start passes."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", year("o_orderdate").alias("y"))
    start = o.where("o_orderstatus = 'P'").groupBy("o_custkey").agg((F.min("y") + 3).alias("start"))
    return o.join(start, "o_custkey", "left").where(gates.in_time(F.col("y"), F.col("start"), 2000, 1)).select("o_orderkey", "o_custkey")


@query("""
SELECT c.c_custkey, n.n_name, coalesce(r.r_name, 'none') AS region FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 1) r ON n.n_regionkey = r.r_regionkey
""")
def join_left_coalesce(spark, d):
    """[J1, J2, J23] Small dimensions; Spark broadcasts them by their size."""
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_regionkey <> 1"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = table(spark, d, "customer")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti(spark, d):
    """[J5]"""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.05) AS n FROM orders o")
def join_correlated_count(spark, d):
    """[J6] As a join to a pre-aggregate."""
    n = table(spark, d, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").fillna(0, ["n"])


@query("""
WITH a AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS only_ FROM part GROUP BY 1, 2)
SELECT p.p_partkey, CASE WHEN a.n = 1 THEN 'matched' ELSE 'ambiguous' END AS bucket, CASE WHEN a.n = 1 THEN a.only_ END AS resolved FROM part p JOIN a USING (p_brand, p_type)
""")
def join_unique_alias(spark, d):
    """[J11, J24, J27] A label resolves only if it stands for one thing."""
    p = table(spark, d, "part")
    a = p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("only_"))
    one = F.col("n") == 1
    return p.join(a, ["p_brand", "p_type"]).select("p_partkey", F.when(one, "matched").otherwise("ambiguous").alias("bucket"), F.when(one, F.col("only_")).alias("resolved"))


@query("""
WITH w AS (SELECT l_orderkey, max(l_extendedprice) AS top FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, min(l.l_linenumber)::BIGINT AS line FROM lineitem l JOIN w ON l.l_orderkey = w.l_orderkey AND l.l_extendedprice = w.top GROUP BY 1
""")
def argmax_per_group(spark, d):
    """[R4, W8] The best row of each group, ties to the first line; one partial aggregate, no window."""
    best = F.max_by(F.col("l_linenumber"), F.struct("l_extendedprice", -F.col("l_linenumber")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(best.cast("long").alias("line"))


@query("""
SELECT l_suppkey, year(l_shipdate)::BIGINT AS year, count(*) AS total, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned,
 sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open,
 sum(CASE WHEN v < 2 THEN 1 ELSE 0 END)::BIGINT AS band_low, sum(CASE WHEN v >= 2 AND v < 5 THEN 1 ELSE 0 END)::BIGINT AS band_medium,
 sum(CASE WHEN v >= 5 THEN 1 ELSE 0 END)::BIGINT AS band_high, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END)::BIGINT AS band_unknown, round(avg(v), 3) AS mean_value
FROM (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_quantity / 8 END AS v FROM lineitem) GROUP BY 1, 2
""")
def yearly_counters(spark, d):
    """[A5, A6, A16, X12] All counters of a fold in one pass."""
    rows = table(spark, d, "lineitem").withColumn("year", year("l_shipdate"))
    v = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 8)
    return yearly.counters(rows, ["l_suppkey", "year"], v, {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"})


@query("""
WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_quantity) AS rn FROM lineitem)
SELECT l_suppkey, count(*) AS works, sum(l_quantity)::BIGINT AS quantity FROM f WHERE rn = 1 GROUP BY 1
""")
def yearly_first_wins(spark, d):
    """[A5, U6] One row for each (person, work), the first."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return yearly.first_wins(rows, ["l_suppkey", "l_orderkey"], ["l_linenumber", "l_quantity"]).groupBy("l_suppkey").agg(F.count("*").alias("works"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1, 2),
a AS (SELECT o_custkey, unnest(generate_series(min(year), 2001)) AS year FROM y GROUP BY 1)
SELECT a.o_custkey, a.year, coalesce(y.n, 0)::BIGINT AS n FROM a LEFT JOIN y USING (o_custkey, year)
""")
def yearly_dense(spark, d):
    """[W10, A41] Zero-filled years from the first to the release."""
    y = table(spark, d, "orders").groupBy("o_custkey", year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return yearly.densified(y, ["o_custkey"], "year", 2001, ["n"])


@query("""
WITH base AS (SELECT l_suppkey, year(l_shipdate)::BIGINT AS year, 1 AS n, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r FROM lineitem WHERE l_linenumber > 1),
delta AS (SELECT l_suppkey, year(l_shipdate)::BIGINT AS year, CASE WHEN l_linenumber = 1 THEN 1 ELSE -1 END AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r FROM lineitem WHERE l_linenumber IN (1, 2))
SELECT l_suppkey, year, greatest(sum(n), 0)::BIGINT AS n, greatest(sum(r), 0)::BIGINT AS r FROM (SELECT l_suppkey, year, n, r FROM base UNION ALL SELECT l_suppkey, year, s, s * r FROM delta) GROUP BY 1, 2
HAVING greatest(sum(n), 0) + greatest(sum(r), 0) > 0
""")
def yearly_signed_delta(spark, d):
    """[A8, A9] Works added and removed without a new fold."""
    rows = table(spark, d, "lineitem").select("l_suppkey", year("l_shipdate").alias("year"), "l_linenumber", F.lit(1).cast("long").alias("n"), (F.col("l_returnflag") == "R").cast("long").alias("r"))
    base = rows.where("l_linenumber > 1").groupBy("l_suppkey", "year").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    return yearly.changed(base, rows.where("l_linenumber <= 2").withColumn("sign", F.when(F.col("l_linenumber") == 1, 1).otherwise(-1)), ["l_suppkey", "year"], ["n", "r"])


@query("SELECT c_nationkey::BIGINT AS nation, c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer GROUP BY 1, 2, c_nationkey")
def stats_shares(spark, d):
    """[A12, A18]"""
    return yearly.shares(table(spark, d, "customer").withColumn("nation", F.col("c_nationkey").cast("long")), ["nation"], "c_mktsegment")


@query("SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3, count(c_acctbal) AS n_valid FROM customer GROUP BY 1")
def stats_quantiles(spark, d):
    """[A13]"""
    return yearly.quantiles(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")


@query("""
SELECT c_mktsegment, count(*) AS n, round(sum(CASE WHEN c_acctbal >= 0 AND n_regionkey > 0 THEN 1 ELSE 0 END) / count(*), 6) AS lower,
 round((sum(CASE WHEN c_acctbal >= 0 AND n_regionkey > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)) / count(*), 6) AS upper
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def stats_bounds(spark, d):
    """[A15] Identification bounds."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return yearly.bounds(c, ["c_mktsegment"], F.col("n_regionkey") > 0, F.col("c_acctbal") < 0)


@query("""
SELECT l_suppkey, p_brand, n, rank FROM (SELECT l_suppkey, p_brand, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_brand) AS rank
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE rank <= 3
""")
def rank_top_in_group(spark, d):
    """[A11, R2] Top 3 brands of each supplier, ties by name."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return yearly.top_in_group(rows.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n")), ["l_suppkey"], [F.desc("n"), F.col("p_brand")], 3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24 OFFSET 48")
def rank_page(spark, d):
    """[R3, R5] A page of the largest."""
    return yearly.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 24)


@query("SELECT p_brand, count(*) AS size, (row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1)::BIGINT AS label_no FROM part GROUP BY 1")
def rank_relabel(spark, d):
    """[R9]"""
    return yearly.relabelled(table(spark, d, "part"), "p_brand")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS position FROM orders")
def rank_case_order(spark, d):
    """[R1, W7]"""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    order = [F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), "o_orderdate", "o_orderkey"]
    return numbered_in(rows, ["o_custkey"], order, "position").select("o_custkey", "o_orderkey", "position")


@query("""
WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 1997), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 1998)
SELECT l_suppkey, sum(CASE WHEN x AND y THEN 1 ELSE 0 END)::BIGINT AS retained, sum(CASE WHEN NOT x THEN 1 ELSE 0 END)::BIGINT AS added, sum(CASE WHEN NOT y THEN 1 ELSE 0 END)::BIGINT AS removed
FROM (SELECT l_suppkey, l_partkey, bool_or(k = 'a') AS x, bool_or(k = 'b') AS y FROM (SELECT *, 'a' AS k FROM a UNION ALL SELECT *, 'b' AS k FROM b) GROUP BY 1, 2) GROUP BY 1
""")
def set_changes(spark, d):
    """[U1-U3, J21] Kept, added and removed between two years: both years in one tagged union, one shuffle."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y")).where("y in (1997, 1998)")
    both = rows.groupBy("l_suppkey", "l_partkey").agg(F.max(F.col("y") == 1997).alias("x"), F.max(F.col("y") == 1998).alias("z"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.groupBy("l_suppkey").agg(n(F.col("x") & F.col("z")).alias("retained"), n(~F.col("x")).alias("added"), n(~F.col("z")).alias("removed"))


@query("SELECT c_nationkey::BIGINT AS nation, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1")
def set_distinct_sorted(spark, d):
    """[A19, A39, U5]"""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))
    return c.select("nation", F.array_join("s", ",").alias("segments"), F.size("s").cast("long").alias("n"))


@query("""
SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path, count(*) AS n FROM events GROUP BY 1
""")
def nested_documents(spark, d):
    """[A10, S11, S13] One sorted document for each entity."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return documents(e, "user_id", ["ts", "event_id"]).select("user_id", F.array_join(F.col("rows.event_type"), ">").alias("path"), F.size("rows").cast("long").alias("n"))


@query("SELECT user_id, event_type, arg_max(value, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS value FROM events GROUP BY 1, 2")
def source_last_write(spark, d):
    """[S3, S4, V8] Of each key the last row written."""
    e = table(spark, d, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    return last_write(e, ["user_id", "event_type"], "at").select("user_id", "event_type", "value")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) < 1998 AND l_quantity < 10)")
def source_pending(spark, d):
    """[S7, S8, G3] Ids that the ledger lacks."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", F.year("l_shipdate").alias("y"))
    return pending(rows.select("l_partkey").distinct(), rows.where("y < 1998 and l_quantity < 10"), ["l_partkey"])


@query("""
WITH i AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey IS NOT NULL), n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS batch FROM i)
SELECT batch, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM n GROUP BY 1
""")
def source_id_batches(spark, d):
    """[S6]"""
    batches = id_batches(table(spark, d, "lineitem"), "l_partkey", 50)
    return batches.select("batch", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""
WITH t AS (SELECT l_suppkey, count(*) AS total FROM lineitem GROUP BY 1)
SELECT l.l_suppkey, l_shipyear, count(*) AS n, t.total FROM (SELECT *, year(l_shipdate)::BIGINT AS l_shipyear FROM lineitem) l JOIN t USING (l_suppkey) GROUP BY l.l_suppkey, l_shipyear, t.total HAVING count(*) < 0.12 * t.total
""")
def gate_share(spark, d):
    """[F22]"""
    return gates.share_guard(table(spark, d, "lineitem").withColumn("l_shipyear", year("l_shipdate")), ["l_suppkey"], "l_shipyear", 0.12)


@query("""
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'conflict' END AS verdict FROM lineitem GROUP BY 1
""")
def gate_verdicts(spark, d):
    """[F25, V7] Unanimous or quarantined."""
    return gates.verdicts(table(spark, d, "lineitem"), ["l_orderkey"], "verdict", "l_returnflag")


@query("""
SELECT p_partkey, sum(l_quantity)::BIGINT AS quantity, count(*) AS n, (SELECT count(*) FROM lineitem WHERE l_quantity > 45) AS all_large
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_retailprice >= 910 GROUP BY 1 HAVING sum(l_quantity) >= 300 AND count(*) >= 5
""")
def group_having(spark, d):
    """[A3, A4, F15]"""
    l = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    large = l.where("l_quantity > 45").agg(F.count("*").alias("all_large"))
    rows = l.join(table(spark, d, "part").where("p_retailprice >= 910").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("n")).where("quantity >= 300 and n >= 5")
    return rows.withColumn("all_large", F.lit(large.first()[0]).cast("long"))
