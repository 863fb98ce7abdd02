"""Flows over stages: nodes, links, routes and origins, and their options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(people: DataFrame, stages: list[str]) -> DataFrame:
    """People with a value at each stage."""
    return people.dropna(subset=stages)


def missing_by_stage(people: DataFrame, stages: list[str]) -> DataFrame:
    """One row of counters, in one pass."""
    any_ = F.greatest(*(F.col(s).isNull().cast("int") for s in stages))
    return people.agg(F.count("*").alias("n"), F.sum(any_).alias("incomplete"), *(F.sum(F.col(s).isNull().cast("int")).alias(f"missing_{s}") for s in stages))


def grouped_abroad(key: Column, region: Column, chosen: Column | None = None) -> Column:
    """Schools abroad as their region, unless chosen, unresolved, domestic or unknown."""
    keep = region.isin("domestic", "unknown") | (key == "unresolved")
    return F.when(keep | (chosen if chosen is not None else F.lit(False)), key).otherwise(F.concat(F.lit("region:"), region))


def staged_rows(people: DataFrame, who: str, stages: list[str], regions: list[str]) -> DataFrame:
    """One row for each person and stage: a single pass, exploded."""
    cells = F.array(*(F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), F.col(s).alias("key"), F.col(r).alias("region")) for i, (s, r) in enumerate(zip(stages, regions, strict=True))))
    return people.select(who, F.explode(cells).alias("c")).select(who, "c.*")


def nodes(people: DataFrame, who: str, stages: list[str], regions: list[str]) -> DataFrame:
    """[A17] A node for each stage and key: people, its region (unknown if its people disagree)."""
    region = F.when(F.min("region") == F.max("region"), F.min("region")).otherwise("unknown")
    return staged_rows(people, who, stages, regions).groupBy("stage", "key").agg(F.count("*").alias("n"), region.alias("region"))


def links(people: DataFrame, stages: list[str], origin: str) -> DataFrame:
    """[A17] Links between neighbouring stages, by origin and whether last and first stage are the same."""
    same = (F.col(stages[0]) == F.col(stages[-1])).alias("self_hire")
    steps = F.array(*(F.struct(F.lit(i).alias("step"), F.col(a).alias("source"), F.col(b).alias("target")) for i, (a, b) in enumerate(zip(stages, stages[1:], strict=False))))
    rows = people.select(F.col(origin).alias("origin"), same, F.explode(steps).alias("s")).select("origin", "self_hire", F.col("s.step").cast("long").alias("step"), "s.source", "s.target")
    return rows.groupBy("step", "source", "target", "origin", "self_hire").agg(F.count("*").alias("n"))


def routes(people: DataFrame, who: str, stages: list[str], members: bool = False) -> DataFrame:
    """[A17] Whole paths; members as sorted ids, if asked for."""
    aggs = [F.count("*").alias("n")] + ([F.array_sort(F.collect_list(who)).alias("members")] if members else [])
    return people.groupBy(*stages).agg(*aggs)


def restricted_routes(people: DataFrame, selected: DataFrame, who: str, stages: list[str]) -> DataFrame:
    """[A44] Routes recounted over the selected people."""
    return routes(people.join(selected.select(who).distinct(), who, "left_semi"), who, stages)


def options(people: DataFrame, who: str, stages: list[str]) -> DataFrame:
    """[A18] Each stage's keys with their people, those who lack other stages included."""
    rows = people.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("key")) for s in stages))).alias("c")).select("c.*").where("key is not null")
    return rows.groupBy("stage", "key").agg(F.count("*").alias("n"))


def movements(roster: DataFrame, who: str, unit: str, year: str, subject: str | None = None) -> DataFrame:
    """[W5, J21, U3] For each unit and year: count, comparable, and, against the year before, retained, added, removed and what
    became of them.

    roster: distinct (who, unit, year); a null unit is unresolved. A year is compared only with the year before, and only if both cover the
    same subjects. Someone with several units, or an unresolved one, in either year is ambiguous.
    """
    rows = roster.select(who, unit, year, *([subject] if subject else [])).distinct()
    status = rows.groupBy(who, year).agg(F.count("*").alias("k"), F.max(F.col(unit).isNull()).alias("open"))
    covered = rows.groupBy(year).agg(F.array_sort(F.collect_set(F.coalesce(F.col(subject), F.lit("unknown")))).alias("subjects") if subject else F.lit(0).alias("subjects"))
    before = covered.select((F.col(year) + 1).alias(year), F.col("subjects").alias("prior_subjects"))
    years = covered.join(before, year, "left").select(year, (F.col("prior_subjects").isNotNull() & (F.col("prior_subjects") == F.col("subjects"))).alias("comparable"))
    known = rows.where(F.col(unit).isNotNull()).select(who, unit, year)
    # each person-unit-year says "now" in its own year and "before" in the next: one union, one aggregation, no join of years
    both = known.select(who, unit, year, F.lit(True).alias("now")).unionByName(known.select(who, unit, (F.col(year) + 1).alias(year), F.lit(False).alias("now")))
    pairs = both.groupBy(who, unit, year).agg(F.max("now").alias("now"), F.max(~F.col("now")).alias("then"))
    here, then = status.select(who, year, F.col("k").alias("k1"), F.col("open").alias("o1")), status.select(who, (F.col(year) + 1).alias(year), F.col("k").alias("k0"), F.col("open").alias("o0"))
    seen = pairs.join(here, [who, year], "left").join(then, [who, year], "left").join(years, year)
    vague = (F.col("k1") != 1) | (F.col("k0") != 1) | F.col("o1") | F.col("o0")
    c = F.col("comparable")
    n = lambda cond: F.sum(F.when(c & cond, 1).when(c, 0))
    now, was = F.col("now"), F.col("then")
    new, gone = now & ~was, was & ~now
    out = seen.groupBy(unit, year).agg(
        F.sum(now.cast("long")).alias("n"), F.max("comparable").alias("comparable"), n(was).alias("previous"), n(now & was).alias("retained"), n(new).alias("added"), n(gone).alias("removed"),
        n(new & F.col("k0").isNull()).alias("prior_unobserved"), n(new & F.col("k0").isNotNull() & vague).alias("ambiguous_in"), n(new & F.col("k0").isNotNull() & ~vague).alias("moves_in"),
        n(gone & F.col("k1").isNull()).alias("next_unobserved"), n(gone & F.col("k1").isNotNull() & vague).alias("ambiguous_out"), n(gone & F.col("k1").isNotNull() & ~vague).alias("moves_out"),
    )
    return out
