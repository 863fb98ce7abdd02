"""Predicates, gates and cascades of exclusions, each with a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional(column: Column, value) -> Column:
    """column = value; a missing value disables the predicate."""
    return F.lit(True) if value is None else column == F.lit(value)


def holds_text(column: Column, value: str | None) -> Column:
    """Holds value anywhere, whatever the case; a missing value disables the predicate."""
    return F.lit(True) if value is None else F.lower(column).contains(value.lower())


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """[F5, F7, F8, X31] The first rule that holds, or null. A null condition doesn't hold."""
    chain = F.when(F.lit(False), F.lit(""))
    for reason, condition in rules:
        chain = chain.when(condition, reason)
    return chain


def cascade(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    return df.withColumn(name, first_reason(rules))


def reason_counts(df: DataFrame, name: str = "reason", kept: str = "kept") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(name), F.lit(kept)).alias(name)).agg(F.count("*").alias("n"))


def strict_identity(rows: DataFrame, decisions: DataFrame, kept: DataFrame, inconsistent: DataFrame, keys: list[str]) -> DataFrame:
    """[F4, F19, J3, J4, J5] Rows with a positive decision and a kept source for the same keys, and not inconsistent."""
    return rows.join(decisions.where("decision = 'true_paper'"), keys, "left_semi").join(kept, keys, "left_semi").join(inconsistent, keys, "left_anti")


def identity_reason(rows: DataFrame, decisions: DataFrame, kept: DataFrame, inconsistent: DataFrame, keys: list[str]) -> DataFrame:
    """[F5, J12] Rows with ``reason``: missing, namesake, unresolved, no_kept_source, inconsistent, in that order, or null."""
    mark = lambda df, name: df.select(*keys, F.lit(True).alias(name)).distinct()
    one = decisions.groupBy(*keys).agg(F.max("decision").alias("__decision"))
    joined = rows.join(one, keys, "left").join(mark(kept, "__kept"), keys, "left").join(mark(inconsistent, "__bad"), keys, "left")
    reason = first_reason(
        [
            ("missing", F.col("__decision").isNull()),
            ("namesake", F.col("__decision") == "namesake_paper"),
            ("unresolved", F.col("__decision") != "true_paper"),
            ("no_kept_source", F.col("__kept").isNull()),
            ("inconsistent", F.col("__bad").isNotNull()),
        ]
    )
    return joined.withColumn("reason", reason).drop("__decision", "__kept", "__bad")


def in_time(year: Column, start: Column, release: int, lead: int = 5) -> Column:
    """Not more than ``lead`` years before start (null: no bound) and not after the release."""
    return (start.isNull() | (year >= start - lead)) & (year <= release)


def clamped(spells: DataFrame, start: str, end: str, gate: Column) -> DataFrame:
    """Spells that end before the gate go, those that begin before it begin there. No gate: as they are."""
    return spells.where(gate.isNull() | F.col(end).isNull() | (F.col(end) >= gate)).withColumn(start, F.greatest(F.col(start), gate))


def lead_role(position: Column, corresponding: Column, kind: Column, source: Column) -> Column:
    """[F9]"""
    return ((position == "first") | corresponding) & kind.isin("article", "review", "letter", "editorial") & (source == "journal")


def closed_window(year: Column, width: int, last_complete: int) -> Column:
    """[F24]"""
    return year + width <= last_complete


def restricted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """To a set of ids made elsewhere."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def in_scope(condition: Column, key: Column, selected) -> Column:
    """The selected one is always in scope."""
    return condition | (key == F.lit(selected))


def verdicts(rows: DataFrame, keys: list[str], policy: str, verdict: str) -> DataFrame:
    """One verdict for each key: unanimous, else "conflict"; unset by no record is "skip"."""
    found = rows.groupBy(*keys).agg(F.collect_set(verdict).alias("__v"))
    return found.select(*keys, F.when(F.size("__v") == 0, "skip").when(F.size("__v") == 1, F.element_at("__v", 1)).otherwise("conflict").alias(policy))


def share_guard(df: DataFrame, group: list[str], part: str, least: float) -> DataFrame:
    """Parts of a group with less than that share of its rows."""
    counts = df.groupBy(*group, part).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    return counts.join(totals, group).where(F.col("n") < least * F.col("total"))


def namesakes(works: DataFrame, person: str, work: str, coauthors: str, field: str, subfield: str, home: Column, anchor: Column, least: int = 3) -> DataFrame:
    """[F16] person, work, reason (field, subfield or null) by anchors, the works known to be the person's.

    With fewer than ``least`` anchors nothing is judged. A work at home, without coauthors, or that shares two coauthors with the anchors is
    kept; one that shares one must have a field, and one that shares none a subfield, of the anchors.
    """
    rows = works.withColumn("__home", F.coalesce(home, F.lit(False))).withColumn("__anchor", F.coalesce(anchor, F.lit(False)))
    known = rows.where("__anchor").groupBy(person).agg(F.count("*").alias("__n"), F.collect_set(field).alias("__fields"), F.collect_set(subfield).alias("__subfields"))
    names = rows.where("__anchor").select(person, F.explode(coauthors).alias("__c")).distinct()
    shared = rows.where("not __anchor").select(person, work, F.explode(coauthors).alias("__c")).distinct().join(names, [person, "__c"]).groupBy(person, work).agg(F.count("*").alias("__shared"))
    judged = rows.join(known, person, "left").join(shared, [person, work], "left").withColumn("__shared", F.coalesce("__shared", F.lit(0)))
    free = F.col("__home") | F.col("__anchor") | (F.coalesce("__n", F.lit(0)) < least) | (F.size(coauthors) <= 0) | (F.col("__shared") >= 2)
    reason = F.when(free, None).when((F.col("__shared") == 1) & ~F.array_contains("__fields", F.col(field)), "field").when((F.col("__shared") == 0) & ~F.array_contains("__subfields", F.col(subfield)), "subfield")
    return judged.select(person, work, reason.alias("reason"))


def corroborated(works: DataFrame, person: str, work: str, coauthors: str, institution: str, year: str, spells: DataFrame, subject: Column) -> DataFrame:
    """person, work: works with support from the others of the person. Identity: an institution of a spell that holds the
    year, give or take one, or a coauthor
    of another work of the person; and the subject must be right. spells: person, institution, start, end."""
    names = works.select(person, work, F.explode(coauthors).alias("__c")).distinct()
    often = names.groupBy(person, "__c").agg(F.count("*").alias("__n")).where("__n >= 2")  # leaves one's own work out
    by_name = names.join(often, [person, "__c"], "left_semi").select(person, work)
    s = spells.select(person, F.col(institution), F.col("start").alias("__s"), F.col("end").alias("__e"))
    by_place = works.join(s, [person, institution]).where((F.col(year) >= F.col("__s") - 1) & (F.col("__e").isNull() | (F.col(year) <= F.col("__e") + 1))).select(person, work)
    return works.where(subject).select(person, work).join(by_name.unionByName(by_place).distinct(), [person, work], "left_semi")


def career_conflicts(works: DataFrame, spells: DataFrame, person: str, work: str, institutions: str, kinds: str, year: str, shared: Column, subfield_known: Column) -> DataFrame:
    """person, work: works that contradict a career. In a year at a spell's bound (its first two, its last, and the one before
    for faculty) all institutions
    of the work, educational or clinical ones only, differ from the person's, and no coauthors are shared (or one, with a subfield
    that is not the person's)."""
    bound = F.array_distinct(F.array_compact(F.array(F.col("start"), F.col("start") + 1, F.col("end"), F.when(F.col("stage") == "faculty", F.col("end") - 1))))
    at = spells.select(person, "institution", F.explode(bound).alias(year)).distinct().groupBy(person, year).agg(F.collect_set("institution").alias("__own"))
    clash = (F.size(institutions) > 0) & ~F.arrays_overlap(institutions, "__own") & F.forall(kinds, lambda k: k.isin("education", "healthcare"))
    alone = (shared == 0) | ((shared == 1) & ~subfield_known)
    return works.join(at, [person, year]).where(clash & alone).select(person, work)


def matched_eras(texts: DataFrame, eras: list[dict], text: str, year: str, place: str) -> Column:
    """The first era that fits: by place id, else by pattern (include and not exclude) of the text, else by year alone. eras:
    name, place, include, exclude, start, end."""
    del texts
    inside = lambda e: (F.col(year) >= e["start"]) & (F.col(year) <= e["end"])
    chain = F.when(F.lit(False), F.lit(""))
    for e in eras:
        chain = chain.when(inside(e) & (F.col(place) == e["place"]), e["name"])
    for e in eras:
        chain = chain.when(inside(e) & F.col(text).rlike(e["include"]) & ~(F.col(text).rlike(e["exclude"]) if e.get("exclude") else F.lit(False)), e["name"])
    for e in eras:
        chain = chain.when(inside(e), e["name"])
    return chain


def accepted(unique_name: Column, kind_ok: Column, field_ok: Column, placed: Column, shared: Column, medical: Column) -> Column:
    """The reason against a work of a person with few works, or null."""
    return first_reason([("kind", ~kind_ok), ("medical", medical), ("field", ~field_ok), ("name", ~unique_name), ("unsupported", ~placed & (shared < 2))])


def visible_edges(edges: DataFrame, node: str, selected, mode: str = "smallest") -> DataFrame:
    """All edges, those of the selected node, or its smallest one that isn't temporal. edges: edge, kind, size, incidence by node."""
    own = edges if mode == "all" else edges.where(F.col(node) == F.lit(selected))
    if mode != "smallest":
        return own.select("edge", "kind", "size").distinct()
    return own.where("kind <> 'temporal'").select("edge", "kind", "size").distinct().orderBy("size", "edge").limit(1)
