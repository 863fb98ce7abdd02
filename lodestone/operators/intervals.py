"""Spells and islands over integer times, ends included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(points: DataFrame, keys: list[str], at: str, gap: int = 1) -> DataFrame:
    """[W1, W3] (keys, start, end, n): runs of points at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    runs = points.select(*keys, at).where(F.col(at).isNotNull()).distinct().withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "__run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("__run")


def merged(spells: DataFrame, keys: list[str], start: str, end: str, gap: int, aggs: list[Column], order: list[str] | None = None) -> DataFrame:
    """[W2] Spells of a key that begin at most ``gap`` after the largest end so far become one. Spells without a start or an end stay alone.

    By a running maximum, so keys must hold whatever forbids a merge (stage, institution, kind of evidence).
    """
    ties = order or []
    w = Window.partitionBy(*keys, "__open").orderBy(start, end, *ties)
    open_ = F.col(start).isNull() | F.col(end).isNull()
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spells.withColumn("__open", F.when(open_, F.xxhash64(*spells.columns))).withColumn("__new", F.coalesce((F.col(start) > before + gap).cast("int"), F.lit(1)))
    runs = marked.withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "__open", "__run").agg(F.min(start).alias(start), F.max(end).alias(end), *aggs).drop("__open", "__run")


def points_of(spells: DataFrame, start: str, end: str, name: str) -> DataFrame:
    return spells.withColumn(name, F.explode(F.sequence(start, end)))


def subtracted(spells: DataFrame, points: DataFrame, keys: list[str], on: list[str], start: str, end: str) -> DataFrame:
    """[W4] What remains of spells (identified by keys) without the points of the same ``on``, as islands. points: on, at."""
    left = points_of(spells.select(*dict.fromkeys([*keys, *on]), start, end), start, end, "at").join(points.select(*on, "at").distinct(), [*on, "at"], "left_anti")
    return islands(left, keys, "at").withColumnsRenamed({"start": start, "end": end}).drop("n")


def covering(points: DataFrame, spells: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """[J7] Points with each spell of the same keys that holds them; a null end is open."""
    return points.join(spells, on).where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) <= F.col(end))))


def overlaps(spells: DataFrame, unit: list[str], who: str, start: str, end: str, width: int = 8) -> DataFrame:
    """[J8] Pairs of different people whose spells at a unit overlap, with the common part. A spell is filed under each block of
    ``width`` times that it
    touches, and a pair is found in the block where its common part begins: so a unit of long standing isn't one group."""
    filed = spells.select(*unit, who, start, end).withColumn("__block", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    a, b = (filed.select(*unit, "__block", F.col(who).alias(f"{who}_{x}"), F.col(start).alias(f"__s{x}"), F.col(end).alias(f"__e{x}")) for x in "ab")
    both = a.join(b, [*unit, "__block"]).where(F.col(f"{who}_a") < F.col(f"{who}_b")).withColumn(start, F.greatest("__sa", "__sb")).withColumn(end, F.least("__ea", "__eb"))
    return both.where((F.col(start) <= F.col(end)) & (F.floor(F.col(start) / width) == F.col("__block"))).select(*unit, f"{who}_a", f"{who}_b", start, end)


def as_of(points: DataFrame, spells: DataFrame, on: list[str], at: str, start: str, end: str, value: str) -> DataFrame:
    """[R6] For each point the latest spell that holds it, else the latest that began before, else the first: its value."""
    rank = F.when((F.col(start) <= F.col(at)) & (F.coalesce(F.col(end), F.col(at)) >= F.col(at)), 2).when(F.col(start) <= F.col(at), 1).otherwise(0)
    later = F.when(rank > 0, F.col(start)).otherwise(-F.col(start))
    found = points.join(spells, on).groupBy(*points.columns).agg(F.max(F.struct(rank.alias("r"), later.alias("s"), F.col(value).alias("v"))).alias("__b"))
    return found.select(*points.columns, F.col("__b.v").alias(value))


def split_at(spells: DataFrame, start: str, end: str, cut: int, name: str, before: Column, after: Column) -> DataFrame:
    """[W19] Spells over the cut become two; name says which part."""
    s, e = F.col(start), F.col(end)
    part = lambda a, b, v: F.struct(a.alias("a"), b.alias("b"), v.alias("v"))
    parts = F.when((s < cut) & (e >= cut), F.array(part(s, F.lit(cut - 1).cast("long"), before), part(F.lit(cut).cast("long"), e, after))).when(e < cut, F.array(part(s, e, before))).otherwise(F.array(part(s, e, after)))
    return spells.withColumn("__p", F.explode(parts)).withColumn(start, F.col("__p.a")).withColumn(end, F.col("__p.b")).withColumn(name, F.col("__p.v")).drop("__p")


def stage_of_year(years: DataFrame, spells: DataFrame, on: list[str], year: str, start: str, end: str, priority: Column, fallback: Column) -> DataFrame:
    """[W9] The stage of largest priority among spells that hold the year, else the fallback."""
    held = (F.col(start) <= F.col(year)) & (F.col(end) >= F.col(year))
    best = F.max_by(F.when(held, F.col("stage")), F.when(held, priority)).alias("__s")
    return years.join(spells, on, "left").groupBy(*years.columns).agg(best).select(*years.columns, F.coalesce("__s", fallback).alias("stage"))


def bins(year: Column, first: Column, width: int) -> Column:
    """[W11]"""
    return F.floor((year - first) / width).cast("long")


def relative_rank(df: DataFrame, group: list[str], order: str, name: str = "place") -> DataFrame:
    """[W16] 0 for the first of a group, 1 for the last."""
    return df.withColumn(name, F.percent_rank().over(Window.partitionBy(*group).orderBy(order)))


def bands(spells: DataFrame, group: str, ident: str, start: str, end: str) -> DataFrame:
    """[W18] The first row, from 0, of a group in which a spell doesn't touch an earlier one. First fit is sequential, so a group is
    one task's."""
    import heapq

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([start, end, ident])
        free: list[int] = []
        busy: list[tuple[int, int]] = []
        out, used = [], 0
        for s, e in zip(rows[start], rows[end], strict=True):
            while busy and busy[0][0] < s:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                band = heapq.heappop(free)
            else:
                band, used = used, used + 1
            heapq.heappush(busy, (e, band))
            out.append(band)
        return pd.DataFrame({group: rows[group], ident: rows[ident], "band": out})

    kinds = {c: spells.schema[c].dataType.simpleString() for c in (group, ident)}
    return spells.select(group, ident, start, end).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {ident} {kinds[ident]}, band long")
