"""Table scans and sinks: Parquet tables, JSON-lines shards with last write wins, CSV, nested JSON documents, XML records, columnar
layouts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.numbering import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """[S1] A read-only scan; filters and columns are pushed into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tolerant(df: DataFrame, schema: StructType) -> DataFrame:
    """schema's columns; those that df lacks are null."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def json_shards(spark: SparkSession, pattern: str, schema: StructType, keys: list[str]) -> DataFrame:
    """[S3, S4] Shards of JSON lines, gzipped or not; of several rows of a key the last by shard name and place in it: a large file
    is read in pieces, whose tasks
    have no order, so a piece's start comes before a row's number in its task. Blank lines are skipped."""
    rows = spark.read.schema(schema).json(pattern).select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("__at"))
    return last_write(rows.where(F.coalesce(*(F.col(k).cast("string") for k in keys)).isNotNull()), keys, "__at").drop("__at")


def last_write(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of each key the row with the largest ``at``: a partial aggregate, so a hot key is reduced before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.col(at)).alias("__row")).select("__row.*")


def pending(wanted: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """[S7] What the ledger hasn't yet."""
    return wanted.join(ledger.select(*keys).distinct(), keys, "left_anti")


def id_batches(df: DataFrame, column: str, size: int) -> DataFrame:
    """[S6] Distinct ids, ascending, in batches of ``size``, the last one of what is left: (batch, ids). Ids are numbered by ranges,
    so no task sees them all."""
    ids = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [(F.col(column), True)], "number")
    return ids.groupBy(F.expr(f"number div {size}").alias("batch")).agg(F.array_sort(F.collect_list(column)).alias("ids"))


def xml_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """[S9] Records of XML text. A document type declaration is refused: its row's record is null."""
    safe = F.when(~F.upper(F.col(column)).contains("<!DOCTYPE") & ~F.upper(F.col(column)).contains("<!ENTITY"), F.col(column))
    return df.withColumn("record", F.from_xml(safe, schema))


def documents(df: DataFrame, key: str, order: list[str], name: str = "rows") -> DataFrame:
    """[S11, S13, A10] One nested document for each key, its rows sorted."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def as_json(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("document"))


def content_hash(*columns: Column) -> Column:
    """[S14, X32] SHA-256 of rows in canonical form."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def batch_key(kind: str, payload: str) -> str:
    return hashlib.sha256(f"{kind}\n{payload}".encode()).hexdigest()


def columnar(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """[S19] Rows to one array for each column, sorted."""
    packed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return df.groupBy(key).agg(packed.alias("__p")).select(key, *(F.col(f"__p.{c}").alias(c) for c in columns))


def rowwise(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """[S19] Arrays of columns back to rows."""
    return df.select(key, F.explode(F.arrays_zip(*columns)).alias("__z")).select(key, *(F.col(f"__z.{c}").alias(c) for c in columns))


def hierarchy(df: DataFrame, key: str, levels: list[str]) -> DataFrame:
    """[S15] Arrays of (area, work_count, share), one for each level, to one table."""
    out = None
    for level in levels:
        rows = df.select(key, F.lit(level).alias("level"), F.explode(level).alias("a")).select(key, "level", F.col("a.area").alias("area"), F.col("a.work_count").cast("long").alias("work_count"), F.round("a.share", 4).alias("share"))
        out = rows if out is None else out.unionByName(rows)
    return out


def workbook_ids(df: DataFrame, column: str, pattern: str = r"(A\d{10})", least: int = 2) -> DataFrame:
    """[S20] Rows of a sheet (as text) that hold at least so many different ids."""
    return df.withColumn("ids", F.array_sort(F.array_distinct(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))))).where(F.size("ids") >= least)


def synthetic_refs(spark: SparkSession, works: int, pool: int, refs: int, seed: int = 0) -> DataFrame:
    """[S18] (work, ref): each work cites from a pool that drifts with its number, with a Pareto-like preference for early members."""
    at = F.floor(F.pow(F.rand(seed), F.lit(2.5)) * pool).cast("long")
    return spark.range(works).select(F.col("id").alias("work"), F.explode(F.sequence(F.lit(1), F.lit(refs)))).select("work", (F.floor(F.col("work") / 10) + at).alias("ref")).distinct()


def sealed(c: Column, key: Column) -> Column:
    """[S16] AES-256-GCM."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def opened(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """[S12] Overwrites."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """[S10] Quotes are doubled; nulls are empty cells, empty texts quoted ones."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """[S10] What ``write_csv`` wrote, cells of several lines as well. A row that doesn't fit the schema fails."""
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True, mode="FAILFAST")


def numbered_in(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
