"""Versions of works by their titles, and variants of names."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.sets import HUB
from lodestone.operators.staging import staged


#: Fixed value: what isn't part of a title's words.
NO_WORD = "[^a-z0-9 ]"


def alike(works: DataFrame, jaccard: float, contained: float) -> DataFrame:
    """(person, a, b): works of a person whose titles are alike. works: person, work, words (a set).

    Of two titles that are alike, the shorter one, of s words, shares at least ``least * s`` of them, least being the smaller of
    both bounds; so one shared word is among its ``s - ceil(least * s) + 1`` rarest. Those alone are looked up,
    among all words of titles that are as long or longer.
    """
    least = min(jaccard, contained)
    each = works.where(F.size("words") > 0).select("person", "work", "words", F.size("words").alias("n"))
    words = each.select("person", "work", "n", F.explode("words").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    ranked = words.join(often, "word").groupBy("person", "work", "n").agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("r"))
    rare = F.transform(F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")), lambda x: x["word"])
    short = ranked.select("person", F.col("work").alias("a"), F.col("n").alias("na"), F.explode(rare).alias("word"))
    long = words.select("person", F.col("work").alias("b"), F.col("n").alias("nb"), "word")
    met = short.join(long, ["person", "word"]).where("na < nb or na = nb and a < b").select("person", "a", "b").distinct()
    x, y = (each.select("person", F.col("work").alias(c), F.col("words").alias(f"w{c}")) for c in "ab")
    both = met.join(x, ["person", "a"]).join(y, ["person", "b"]).withColumn("both", F.size(F.array_intersect("wa", "wb")))
    na, nb = F.size("wa"), F.size("wb")
    return both.where((F.col("both") / (na + nb - F.col("both")) >= jaccard) | (F.col("both") / F.least(na, nb) >= contained)).select("person", "a", "b")


def merged_versions(works: DataFrame, person: str, work: str, title: str, year: str, jaccard: float = 0.55, contained: float = 0.85) -> DataFrame:
    """[J17] person, work, head: in order of years (none: first), then works, a work joins the first group whose head's title is
    like its own: Jaccard similarity of words, or containment of
    one's words in the other's, at least so large; else it heads a group. Works are named once; a title without words heads a group
    of its own.

    By rounds, over pairs of titles that are alike: a work settles once it has a head among those before it, or once none of them
    can be one. All people's works settle at once; rounds are as many as the longest
    chain of works that wait for one another.
    """
    text = F.regexp_replace(F.lower(F.coalesce(F.col(title), F.lit(""))), NO_WORD, " ")
    rows = staged(
        works.select(
            F.col(person).alias("person"),
            F.col(work).alias("work"),
            F.struct(F.coalesce(F.col(year), F.lit(0)).alias("year"), F.col(work).alias("work")).alias("at"),
            F.array_distinct(F.filter(F.split(text, " +"), lambda w: w != "")).alias("words"),
        )
    )
    at = rows.select("person", "work", "at")
    near = alike(rows, jaccard, contained)
    near = near.join(at.withColumnRenamed("work", "a").withColumnRenamed("at", "at_a"), ["person", "a"]).join(at.withColumnRenamed("work", "b").withColumnRenamed("at", "at_b"), ["person", "b"])
    earlier = F.col("at_a") < F.col("at_b")
    waits = staged(near.select("person", F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("work"), F.when(earlier, F.col("at_a")).otherwise(F.col("at_b")).alias("first")))
    state = rows.select("person", "work").join(waits.select("person", "work").distinct().withColumn("waits", F.lit(True)), ["person", "work"], "left").select("person", "work", F.when(F.col("waits").isNull(), True).alias("heads"))
    state = staged(state)
    while not state.where("heads is null").isEmpty():
        open_ = waits.join(state.where("heads is null").select("person", "work"), ["person", "work"], "left_semi")
        seen = open_.withColumn("of", F.col("first")["work"]).join(state.withColumnRenamed("work", "of").withColumnRenamed("heads", "is"), ["person", "of"])
        found = seen.groupBy("person", "work").agg(F.max(F.coalesce("is", F.lit(False))).alias("any"), F.max(F.col("is").isNull()).alias("open"))
        settled = F.when(F.col("any"), False).when(~F.col("open"), True)
        state = staged(state.join(found, ["person", "work"], "left").select("person", "work", F.coalesce("heads", settled).alias("heads")))
    heads = state.where("heads").select("person", F.col("work").alias("of"))
    joined = waits.withColumn("of", F.col("first")["work"]).join(heads, ["person", "of"]).groupBy("person", "work").agg(F.min("first").alias("first"))
    out = state.join(joined, ["person", "work"], "left").select(F.col("person").alias(person), F.col("work").alias(work), F.when(F.col("heads"), F.col("work")).otherwise(F.col("first")["work"]).alias("head"))
    return out


def name_variants(family: str, given: list[str], spellings: dict[str, list[str]]) -> list[str]:
    """[X19] Spellings of a romanised name: family name and syllables, joined, hyphenated or apart, in either order."""
    options = [spellings.get(p, [p]) for p in given]
    out = set()
    for f in spellings.get(family, [family]):
        for parts in itertools.product(*options):
            for sep in ("", "-", " "):
                first = sep.join(parts)
                out |= {f"{first} {f}", f"{f} {first}", f"{f}, {first}"}
    return sorted(out)


def suppressed(terms: DataFrame, term: str, names: DataFrame, boilerplate: tuple[str, ...]) -> DataFrame:
    """[X20] Terms without people's names (a table of names) and boilerplate words."""
    bad = F.lit(False)
    for b in boilerplate:
        bad = bad | F.lower(term).contains(b)
    return terms.where(~bad).join(names.select(F.col(names.columns[0]).alias(term)).distinct(), term, "left_anti")


def births(pairs: DataFrame, topics: DataFrame) -> DataFrame:
    """[J15, R4] topic, parent, similarity: of a topic's works in its first era, the most similar work of another topic in an
    earlier one; ties to the earliest and smallest
    work. pairs: a, b, similarity, both ways; topics: work, topic, era."""
    first = topics.groupBy("topic").agg(F.min("era").alias("birth"))
    born = topics.join(first, "topic").where("era = birth").select(F.col("work").alias("a"), "topic", "birth")
    old = topics.select(F.col("work").alias("b"), F.col("topic").alias("parent"), "era")
    fit = born.join(pairs, "a").join(old, "b").where("era < birth and topic <> parent")
    best = F.max_by(F.struct("parent", "similarity"), F.struct("similarity", -F.col("era"), -F.col("a"), -F.col("b")))
    return fit.groupBy("topic").agg(best.alias("x")).select("topic", "x.parent", "x.similarity")


def births_by_refs(incidence: DataFrame, topics: DataFrame) -> DataFrame:
    """[J15, R4] ``births`` with the Salton similarity by common refs, rounded to six digits. Only a work of some topic's first era
    is paired, and only with works of eras before it, so other works' pairs aren't made. Refs of many works are made by several
    tasks. incidence: work, ref; topics: work, topic, era."""
    topics = staged(topics)
    first = topics.groupBy("topic").agg(F.min("era").alias("birth"))
    born = topics.join(first, "topic").where("era = birth").groupBy("work").agg(F.max("birth").alias("birth"))
    last = first.agg(F.max("birth").alias("last"))
    old = topics.join(last, F.col("era") < F.col("last")).groupBy("work").agg(F.min("era").alias("era"))
    rows = staged(incidence.select("work", "ref").join(born.join(old, "work", "full"), "work").distinct())
    n = rows.groupBy("work").agg(F.count("*").alias("n"))
    late = rows.where("birth is not null").select("ref", F.col("work").alias("a"), "birth")
    early = rows.where("era is not null").select("ref", F.col("work").alias("b"), "era")
    hubs = early.groupBy("ref").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    salted = early.join(hubs, "ref").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    spread = late.join(hubs, "ref").select("ref", "a", "birth", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    met = spread.join(salted, ["ref", "salt"]).where("a <> b and era < birth").groupBy("a", "b").agg(F.count("*").alias("shared"))
    na, nb = (n.select(F.col("work").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = met.join(na, "a").join(nb, "b").select("a", "b", F.round(F.col("shared") / F.sqrt(F.col("n_a") * F.col("n_b")), 6).alias("similarity"))
    return births(pairs, topics)
