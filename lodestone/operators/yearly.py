"""Folds by year: counters in one pass, dense years, signed changes, bands, quantiles, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.numbering import numbered


def band(v: Column, low: float = 2.0, high: float = 5.0) -> Column:
    """[X12]"""
    return F.when(v.isNull(), "unknown").when(v < low, "low").when(v < high, "medium").otherwise("high")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """[A5, U6] Of each key the first row by order; reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__r")).select(*keys, "__r.*")


def counters(df: DataFrame, keys: list[str], value: Column, flags: dict[str, Column], cited: Column | None = None) -> DataFrame:
    """[A5, A6, A16] In one pass: total, a count for each flag, for each band, and the rounded mean of known values."""
    b = band(value)
    aggs = [F.count("*").alias("total")]
    aggs += [F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in flags.items()]
    aggs += [F.sum(F.when(b == k, 1).otherwise(0)).alias(f"band_{k}") for k in ("low", "medium", "high", "unknown")]
    aggs += [F.round(F.avg(value), 3).alias("mean_value")]
    return df.groupBy(*keys).agg(*aggs, *([F.sum(cited).alias("cited")] if cited is not None else []))


def densified(df: DataFrame, keys: list[str], year: str, last: int, zero: list[str]) -> DataFrame:
    """[W10] A row for each year from the key's first to ``last``, zero where there was none."""
    axis = df.groupBy(*keys).agg(F.min(year).alias("__a")).where(F.col("__a") <= last).select(*keys, F.explode(F.sequence(F.col("__a").cast("long"), F.lit(last).cast("long"))).alias(year))
    return axis.join(df, [*keys, year], "left").fillna(0, zero)


def changed(base: DataFrame, delta: DataFrame, keys: list[str], counts: list[str], sign: str = "sign") -> DataFrame:
    """[A8, A9] base with signed rows added, never below zero. Keys that end at zero in all counts go."""
    rows = base.select(*keys, *counts).unionByName(delta.select(*keys, *((F.col(c) * F.col(sign)).alias(c) for c in counts)))
    out = rows.groupBy(*keys).agg(*(F.greatest(F.sum(c), F.lit(0)).alias(c) for c in counts))
    return out.where(sum((F.col(c) for c in counts), F.lit(0)) > 0)


def shares(df: DataFrame, group: list[str], label: str, n: str = "n") -> DataFrame:
    """[A12] Count and share of each label, unknown ones in the denominator."""
    counts = df.groupBy(*group, F.coalesce(F.col(label), F.lit("unknown")).alias(label)).agg(F.count("*").alias(n))
    total = F.sum(n).over(Window.partitionBy(*group)) if group else F.sum(n).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.round(F.col(n) / total, 6))


def quantiles(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """[A13] Exact quantiles with linear interpolation at h = (n - 1) p."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*group).agg(p.alias("__p"), F.count(value).alias("n_valid")).select(*group, F.col("__p")[0].alias("q1"), F.col("__p")[1].alias("median"), F.col("__p")[2].alias("q3"), "n_valid")


def bounds(df: DataFrame, group: list[str], foreign: Column, unknown: Column) -> DataFrame:
    """[A15] A share's bounds when some labels are unknown."""
    f, u, n = F.sum(F.when(foreign & ~unknown, 1).otherwise(0)), F.sum(F.when(unknown, 1).otherwise(0)), F.count("*")
    return df.groupBy(*group).agg(n.alias("n"), F.round(f / n, 6).alias("lower"), F.round((f + u) / n, 6).alias("upper"))


def top_in_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """[A11, R2, R8] The first k of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """[R5, R3]"""
    return df.orderBy(*order).offset(number * size).limit(size)


def relabelled(df: DataFrame, label: str, new: str = "label_no") -> DataFrame:
    """[R9] Labels numbered by size, descending, then label."""
    return numbered(df.groupBy(label).agg(F.count("*").alias("size")), [(F.col("size"), False), (F.col(label), True)], new)


def summed_years(docs: DataFrame, who: str, years: str, group: list[str]) -> DataFrame:
    """[A7] Nested yearly rows (year, n) of many people, summed; means of different people aren't averaged."""
    rows = docs.select(*group, F.explode(years).alias("y")).select(*group, "y.*")
    return rows.groupBy(*group, "year").agg(F.sum("n").alias("n"), F.lit(None).cast("double").alias("mean"))


def tag_cloud(df: DataFrame, tags: str, k: int) -> DataFrame:
    """[A36, R3] The k most frequent tags, ties by name."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def cells(df: DataFrame, row: str, column: str, cited: str) -> DataFrame:
    """[A37] Works and citations by row and column; those without a column are "unplaced"."""
    return df.groupBy(row, F.coalesce(F.col(column).cast("string"), F.lit("unplaced")).alias(column)).agg(F.count("*").alias("n"), F.sum(cited).alias("cited"))


def community_summary(df: DataFrame, community: str, who: str, year: str, label: str, k: int) -> DataFrame:
    """[A24] Size, people, median and range of years, and the first k labels with their shares."""
    base = df.groupBy(community).agg(F.count("*").alias("size"), F.countDistinct(who).alias("people"), F.percentile(year, F.lit(0.5)).alias("median_year"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    top = top_in_group(df.groupBy(community, label).agg(F.count("*").alias("n")), [community], [F.desc("n"), F.col(label)], k)
    named = top.join(base.select(community, "size"), community).groupBy(community).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col(label), F.lit(" "), F.round(100 * F.col("n") / F.col("size")).cast("long").cast("string"), F.lit("%")).alias("t")))), lambda x: x["t"]), ", ").alias("labels"))
    return base.join(named, community)
