"""Sources and sinks: what is written is read back, and what is read is what the tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import periods, text
from lodestone.operators.staging import shared_folder
from lodestone.plans.registry import query
from lodestone.sources import tables
from lodestone.sources.tables import table


def place(spark) -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 9 > 0 THEN 'a \"quoted\", ' || chr(10) || o_orderpriority END AS note, year(o_orderdate) AS y FROM orders")
def source_csv(spark, d):
    """[S10] Written with quotes, commas and line ends in a cell, and read back."""
    note = F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.lit('a "quoted", \n'), F.col("o_orderpriority")))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", note.alias("note"), F.year("o_orderdate").cast("long").alias("y"))
    path = place(spark)
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query("SELECT y, o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS people FROM (SELECT *, year(o_orderdate) AS y FROM orders) WHERE y BETWEEN 1994 AND 1996 GROUP BY 1, 2")
def source_partitioned(spark, d):
    """[S12] A sink by year, of which only the years that are asked for are read."""
    path = place(spark)
    tables.write_parquet(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y")), path, ["y"])
    return spark.read.parquet(path).where("y between 1994 and 1996").groupBy(F.col("y").cast("long").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("people"))


@query("""
SELECT l_orderkey AS k, arg_max(v, l_linenumber) AS v FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1
""")
def source_shards(spark, d):
    """[S3, S4] JSON lines in gzipped shards, one for each line number, of each order the last one."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("l_suppkey"))
    path = place(spark)
    for n in range(1, 8):
        lines.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v")).coalesce(1).write.json(f"{path}/shard={n}", compression="gzip")
    schema = spark.createDataFrame([], "k long, v long").schema
    return tables.json_shards(spark, f"{path}/shard=*/*.json.gz", schema, ["k"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS name, CASE WHEN n_nationkey % 5 > 0 THEN n_regionkey END AS region FROM nation")
def source_xml(spark, d):
    """[S9] Records of XML, of which those with a document type are refused."""
    n = table(spark, d, "nation")
    body = F.concat(F.lit("<r><name>"), F.col("n_name"), F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></r>"))
    xml = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit('<!doctype r [<!entity x "y">]>'), body)).otherwise(body)
    out = tables.xml_records(n.select("n_nationkey", xml.alias("xml")), "xml", "name string, region long")
    return out.select("n_nationkey", F.col("record.name").alias("name"), F.col("record.region").cast("int").alias("region"))


@query("""
WITH p AS (SELECT p_size AS k, p_brand AS area, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT p_size AS k, p_type AS area, count(*) AS n FROM part GROUP BY 1, 2)
SELECT k, 'brand' AS level, area, n AS work_count, round(n / sum(n) OVER (PARTITION BY k), 4) AS share FROM p UNION ALL SELECT k, 'type', area, n, round(n / sum(n) OVER (PARTITION BY k), 4) FROM t
""")
def source_hierarchy(spark, d):
    """[S15] Nested levels, as JSON documents, imported to one table."""
    p = table(spark, d, "part").withColumnRenamed("p_size", "k")
    levels = None
    for level, column in (("brand", "p_brand"), ("type", "p_type")):
        n = p.groupBy("k", F.col(column).alias("area")).agg(F.count("*").alias("work_count"))
        n = n.join(n.groupBy("k").agg(F.sum("work_count").alias("all")), "k").select("k", F.struct("area", "work_count", (F.col("work_count") / F.col("all")).alias("share")).alias("a"))
        n = n.groupBy("k").agg(F.collect_list("a").alias(level))
        levels = n if levels is None else levels.join(n, "k")
    one = "array<struct<area:string,work_count:long,share:double>>"
    back = tables.as_json(levels, "k").select("k", F.from_json("document", f"brand {one}, type {one}").alias("x")).select("k", "x.*")
    return tables.hierarchy(back, "k", ["brand", "type"])


@query("SELECT c_custkey, c_name FROM customer")
def source_sealed(spark, d):
    """[S16] Names sealed and opened again."""
    key = F.lit(bytes(range(32)))
    sealed = table(spark, d, "customer").select("c_custkey", tables.sealed(F.col("c_name"), key).alias("sealed"))
    return sealed.select("c_custkey", tables.opened(F.col("sealed"), key).alias("c_name"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders")
def source_columnar(spark, d):
    """[S19] Rows to arrays of columns, and back."""
    wide = tables.columnar(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderpriority"])
    return tables.rowwise(wide, "o_custkey", ["o_orderkey", "o_orderpriority"])


_ERA = "CASE o_orderkey % 6 WHEN 0 THEN '(2011-13)' WHEN 1 THEN '(~2010)' WHEN 2 THEN '(2020-)' WHEN 3 THEN '(1998–2004) ' WHEN 4 THEN '(2007)' ELSE 'none' END"


@query(f"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 2011 WHEN 2 THEN 2020 WHEN 3 THEN 1998 WHEN 4 THEN 2007 END AS start, CASE o_orderkey % 6 WHEN 0 THEN 2013 WHEN 1 THEN 2010 WHEN 3 THEN 2004 WHEN 4 THEN 2007 END AS "end",
 CASE WHEN o_orderkey % 4 = 0 THEN 'Department of Physics' WHEN o_orderkey % 4 = 1 THEN 'School of Arts and Letters' END AS unit FROM orders WHERE {_ERA} IS NOT NULL
""")
def text_labels(spark, d):
    """[X11, X25] Years in labels of eras, and the one formal unit of an address."""
    k = F.col("o_orderkey")
    label = F.expr(_ERA)
    address = F.when(k % 4 == 0, "Department of Physics, 12 Road").when(k % 4 == 1, "At the School of Arts and Letters; School of Arts and Letters").when(k % 4 == 2, "Department of Physics, School of Law").otherwise("12 Road")
    era = periods.era_bounds(F.concat(F.lit("Optics "), label))
    return table(spark, d, "orders").select("o_orderkey", era["start"].alias("start"), era["end"].alias("end"), text.department(address).alias("unit"))


@query("""
WITH a AS (SELECT o_custkey, list(DISTINCT o_orderkey % 17 ORDER BY o_orderkey % 17) AS x, list(DISTINCT year(o_orderdate) % 17 ORDER BY year(o_orderdate) % 17) AS y, max(o_totalprice)::DOUBLE AS p FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_intersect(x, y)), ',') AS "both", array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS either, len(list_filter(x, lambda v: v > 12)) > 0 AS some, len(list_filter(y, lambda v: v < 5)) = len(y) AS every,
 round(sqrt(p), 6) AS root, round(log2(p), 6) AS bits, round(asinh(p), 6) AS arc, round(sqrt(p * p + 9), 6) AS far, greatest(0, least(1, p / 400000)) AS clipped FROM a
""")
def scalar_arrays(spark, d):
    """[X27, X28]"""
    o = table(spark, d, "orders")
    a = o.groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 17).alias("x"), F.collect_set((F.year("o_orderdate") % 17).cast("long")).alias("y"), F.max("o_totalprice").cast("double").alias("p"))
    said = lambda c: F.array_join(F.transform(F.array_sort(c), lambda v: v.cast("string")), ",")
    p = F.col("p")
    return a.select(
        "o_custkey",
        said(F.array_intersect("x", "y")).alias("both"),
        said(F.array_union("x", "y")).alias("either"),
        F.exists("x", lambda v: v > 12).alias("some"),
        F.forall("y", lambda v: v < 5).alias("every"),
        *(F.round(c, 6).alias(n) for c, n in ((F.sqrt(p), "root"), (F.log2(p), "bits"), (F.asinh(p), "arc"), (F.hypot(p, F.lit(3.0)), "far"))),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), p / 400000)).alias("clipped"),
    )
