"""Checks that return violations, mutations that return new tables, and review states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_gaps(df: DataFrame, keys: list[str], year: str) -> DataFrame:
    """[V1] Keys whose years aren't all there."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(year).alias("first"), F.max(year).alias("last")).where(F.col("n") != F.col("last") - F.col("first") + 1)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """[V3]"""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """[V3] Rows whose key, not null, isn't in the parent."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def unlike(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """[V1, V3] (rule, n): rows against each rule; one pass. A null condition passes, as in CHECK."""
    one = df.agg(*(F.sum(F.when(~ok, 1).otherwise(0)).alias(k) for k, ok in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("n")) for k in rules))).alias("r")).select("r.*")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """[U4, J20] Ids that only one side has."""
    both = a.select(key, F.lit(1).alias("s")).distinct().unionByName(b.select(key, F.lit(2).alias("s")).distinct()).groupBy(key).agg(F.sum("s").alias("s"))
    return both.where("s < 3").select(key, F.when(F.col("s") == 1, "left").otherwise("right").alias("side"))


def upserted(base: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, str]) -> DataFrame:
    """[V4, G4] base with new rows; columns of rows with equal keys are merged: ``new`` (the new one unless null), ``old`` (the old
    one unless null), min, max."""
    rows = base.select("*", F.lit(0).alias("__w")).unionByName(new.select("*", F.lit(1).alias("__w")))
    how = {
        "new": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__w"))),
        "old": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__w"))),
        "min": F.min,
        "max": F.max,
    }
    return rows.groupBy(*keys).agg(*(how[m](c).alias(c) for c, m in merge.items()))


def conflicts(df: DataFrame, key: str, owner: str) -> DataFrame:
    """[V6, J19, A42] Keys with several owners."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(owner).alias("owners"), F.count("*").alias("n")).where("owners > 1")


def quarantined(df: DataFrame, bad: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """[V9] What stays, and what goes, as JSON."""
    return df.join(bad.select(*keys).distinct(), keys, "left_anti"), df.join(bad.select(*keys).distinct(), keys, "left_semi").select(*keys, F.to_json(F.struct(*df.columns)).alias("archived"))


def agreed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """[V7] One row for each key: fields filled where all known values agree; ``conflict`` lists those that don't."""
    sets = df.groupBy(key).agg(*(F.collect_set(f).alias(f) for f in fields))
    names = F.array_compact(F.array(*(F.when(F.size(f) > 1, F.lit(f)) for f in fields)))
    return sets.select(key, *(F.when(F.size(f) == 1, F.element_at(f, 1)).alias(f) for f in fields), F.array_join(names, ",").alias("conflict"))


def review_state(reviews: DataFrame, link: str, at: str, status: str) -> DataFrame:
    """[V12, V8] Each link's status: that of its latest review; of reviews of one time a rejection goes before a verification."""
    rank = F.when(F.col(status) == "rejected", 2).when(F.col(status) == "verified", 1).otherwise(0)
    return reviews.groupBy(link).agg(F.max_by(status, F.struct(at, rank.alias("r"))).alias(status))


def competing(links: DataFrame, item: str, owner: str, status: str) -> DataFrame:
    """[V12] Verified links of an item to several owners."""
    return conflicts(links.where(F.col(status) == "verified"), item, owner)


def linked_by_parent(items: DataFrame, people: DataFrame, person: str, year: str, award: str, slack: int = 1) -> DataFrame:
    """[J25, J28] Items of people with exactly one degree, whose year is at most ``slack`` from the award's."""
    one = people.groupBy(person).agg(F.count("*").alias("__n"), F.max(award).alias(award)).where("__n = 1").drop("__n")
    return items.join(one, person).where(F.abs(F.col(year) - F.col(award)) <= slack)
