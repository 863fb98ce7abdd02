"""Titles clustered, records linked, anchors found: against the sequential rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import linkage, sets, titles


def sequential(works, jaccard, contained):
    """person, work, head by the rule as it is told."""
    groups: dict = {}
    out = set()
    for person, work, title, _ in sorted(works, key=lambda w: (w[3] or 0, w[1])):
        own = set(re.sub("[^a-z0-9 ]", " ", (title or "").lower()).split())
        for head, words in groups.setdefault(person, []):
            both = len(own & words)
            if both and (both / len(own | words) >= jaccard or both / min(len(own), len(words)) >= contained):
                out.add((person, work, head))
                break
        else:
            groups[person].append((work, own))
            out.add((person, work, work))
    return out


@pytest.mark.parametrize(("jaccard", "contained"), [(0.55, 0.85), (0.3, 0.5), (1.0, 1.0)])
def test_versions_equal_the_sequential_rule(spark, jaccard, contained):
    rng = random.Random(7)
    works = [(k % 6, k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) or rng.choice([None, "", "?!"]), rng.choice([None, *range(1990, 1996)])) for k in range(240)]
    df = spark.createDataFrame(works, "person long, work long, title string, year int")
    got = {tuple(r) for r in titles.merged_versions(df, "person", "work", "title", "year", jaccard, contained).collect()}
    assert got == sequential(works, jaccard, contained)


def test_a_chain_settles(spark):
    """Each title is like its neighbours alone, so heads alternate and each waits for the one before."""
    works = [("p", k, f"w{k} w{k + 1}", 2000 + k) for k in range(9)]
    df = spark.createDataFrame(works, "person string, work long, title string, year int")
    got = {r["work"]: r["head"] for r in titles.merged_versions(df, "person", "work", "title", "year", 0.3, 0.5).collect()}
    assert got == {k: k - k % 2 for k in range(9)}


def test_tiers(spark):
    papers = [(1, "10.1/A", "A Title!", 2000), (2, "doi:10.1/a", "a title", 1999), (3, "10.1/a", "other", 2000), (4, None, "Free", 2001), (5, "10.9/none", "Free", 2001), (6, None, None, 2000), (7, "10.2/b", "Twice", 2005), (8, None, "FREE", 2002)]
    works = [(11, "https://doi.org/10.1/a", "A title", 2000), (12, "10.1/A", "A-title", 2003), (13, None, "free", 2001), (14, "10.2/b", "twice", 2006), (15, "10.2/B", "Twice", 2007), (16, None, "other", 2000), (17, None, None, 2000)]
    kind = "doi string, title string, year int"
    out = linkage.resolved(spark.createDataFrame(papers, f"paper long, {kind}"), spark.createDataFrame(works, f"work long, {kind}"), "paper", "work")
    got = {r["paper"]: (r["work"], r["tier"], r["candidates"], r["status"]) for r in out.collect()}
    assert got == {
        1: (11, 1, 1, "matched"),
        2: (None, 2, 2, "ambiguous"),
        3: (None, None, 0, "unmatched"),
        4: (13, 3, 1, "matched"),
        5: (13, 3, 1, "matched"),
        6: (None, None, 0, "unmatched"),
        7: (None, 2, 2, "ambiguous"),
        8: (None, None, 0, "unmatched"),
    }


def test_an_ambiguous_or_missing_anchor_fails(spark):
    queries = spark.createDataFrame([(1, "a", 2000), (2, "b", 2000), (3, None, 2000)], "query long, name string, year int")
    anchors = spark.createDataFrame([(10, "a", 2000), (10, "a", 2000), (11, "b", 2000), (12, "b", 2000), (13, None, 2000)], "anchor long, name string, year int")
    keys = ["name", "year"]
    assert [tuple(r) for r in linkage.anchored(queries.where("query = 1"), anchors, "query", "anchor", keys).collect()] == [(1, 10)]
    for bad, n in ((2, 2), (3, 0)):
        with pytest.raises(Exception, match=f"query {bad} matches {n} anchors"):
            linkage.anchored(queries.where(f"query = {bad}"), anchors, "query", "anchor", keys).collect()
    soft = linkage.anchored(queries, anchors, "query", "anchor", keys, fail=False).collect()
    assert sorted(tuple(r) for r in soft) == [(1, 10, 1), (2, None, 2), (3, None, 0)]


def test_births_by_refs_makes_only_the_pairs_of_births(spark, monkeypatch):
    rng = random.Random(8)
    refs = [(w, rng.randrange(12)) for w in range(80) for _ in range(5)] + [(w, 99) for w in range(80)]
    topics = [(w, w % 5 if w > 20 else w % 2, w // 10) for w in range(80)] + [(3, 1, 0), (45, 9, 4)]
    inc = spark.createDataFrame(refs, "work long, ref long")
    t = spark.createDataFrame(topics, "work long, topic long, era long")
    one = sets.similarities(inc, "work", "ref").select(F.col("work_a").alias("a"), F.col("work_b").alias("b"), F.col("salton").alias("similarity"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    made = []
    plain = titles.births
    monkeypatch.setattr(titles, "births", lambda pairs, topics: made.append(pairs.count()) or plain(pairs, topics))
    monkeypatch.setattr(titles, "HUB", 7)
    got = sorted(map(tuple, titles.births_by_refs(inc, t).collect()))
    assert got == sorted(map(tuple, plain(both, t).collect())) and len(got) == 4
    assert made[0] < both.count() / 4
