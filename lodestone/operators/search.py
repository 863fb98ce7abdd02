"""Search over people: a field-scoped query language, scored lookups and topic search by tags and vectors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.numbering import numbered

# The query language's fields and their short names.
PREFIXES = {
    "재직": "current", "현직": "current", "소속": "current", "기관": "current", "inst": "current", "current": "current",
    "학부": "bachelor", "학사": "bachelor", "bs": "bachelor", "ba": "bachelor", "bachelor": "bachelor",
    "박사": "phd", "phd": "phd",
    "계열": "subject", "분야": "subject", "field": "subject", "subject": "subject",
    "연구": "area", "연구분야": "area", "주제": "area", "토픽": "area", "area": "area", "topic": "area", "openalex": "area", "oa": "area",
    "이름": "name", "name": "name", "id": "id",
}
#: After NFKC, which makes full-width colons plain.
SEPARATORS = ":="


@dataclass
class Query:
    free: list[str] = field(default_factory=list)
    scoped: list[tuple[str, list[str]]] = field(default_factory=list)


def pieces(text: str) -> Iterator[tuple[str, str]]:
    """(head, value) of each piece of a query; the head is what stands up to the piece's first separator, which is its last
    character; "" if it has none.

    Blanks end a piece, but not within quotes. Quotes open a piece of their own, unless a head and its separator stand right before
    them; then they hold its value. Quotes that aren't closed run to the end.
    """
    at, head, value = 0, None, ""

    def taken() -> tuple[str, str]:
        nonlocal head, value
        piece, head, value = (head or "", value), None, ""
        return piece

    while at < len(text):
        c = text[at]
        if c == '"':
            if value:
                yield taken()
            close = text.find(c, at + 1)
            close = len(text) if close < 0 else close
            value = text[at + 1 : close]
            yield taken()
            at = close
        elif c.isspace():
            if value or head:
                yield taken()
        elif c in SEPARATORS and head is None and value:
            head, value = value + c, ""
        else:
            value += c
        at += 1
    if value or head:
        yield taken()


def parsed(text: str, prefixes: dict[str, str] | None = None) -> Query:
    """[X22, X23] Free words and scoped values. ``phd:mit``, ``phd:"two words"``, ``phd: mit``: a field without a value takes the
    next piece,
    unless that names a field itself. A head that is no field is part of a free word."""
    known = PREFIXES if prefixes is None else prefixes
    read: list[tuple[str | None, list[str]]] = []
    for head, value in pieces(unicodedata.normalize("NFKC", text).lower()):
        field_ = known.get(head[:-1])
        read.append((field_, (value if field_ else head + value).split()))
    out = Query()
    for k, (own, terms) in enumerate(read):
        lent = read[k - 1][0] if k and not read[k - 1][1] else None
        if terms and (own or lent):
            out.scoped.append((own or lent, terms))
        else:
            out.free.extend(terms)
    return out


def holds(text: Column, term: str) -> Column:
    """[X24] Terms of up to three letters or digits must begin a word."""
    if len(term) <= 3 and term.isascii() and term.isalnum():
        return text.rlike(rf"(^|[^a-z0-9]){term}")
    return text.contains(term)


def matches(query: Query, fields: dict[str, Column]) -> tuple[Column, Column]:
    """[Q2] Whether a row matches, and the sorted fields that do: each scoped value in its field, each free word in any that isn't empty.

    Each term is one condition over the fields that it may be met in; a row matches if all are met, and a field is named if a term
    was met there.
    """
    asked = [((scope,), t) for scope, terms in query.scoped for t in terms] + [(tuple(fields), t) for t in query.free]
    met = [{f: (fields[f] != "") & holds(fields[f], t) for f in where if f in fields} for where, t in asked]
    if not all(met):  # a scope that these rows don't have
        return F.lit(False), F.array().cast("array<string>")
    ok = reduce(and_, (reduce(or_, m.values()) for m in met), F.lit(True))
    named = {f: reduce(or_, (m[f] for m in met if f in m), F.lit(False)) for f in fields}
    return ok, F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in named.items()))))


def lookup_score(query: str, label: Column, key: Column, others: dict[int, Column]) -> Column:
    """[Q5] exact 100, prefix 80, contains 60, id 95 or 50; others by their score where they hold the query; 0 if none does."""
    q = query.lower()
    text, k = F.lower(label), F.lower(key)
    cases = [F.when(text == q, 100).when(text.startswith(q), 80).when(text.contains(q), 60).otherwise(0), F.when(k == q, 95).when(k.contains(q), 50).otherwise(0)]
    return F.greatest(*cases, *(F.when(F.lower(c).contains(q), s).otherwise(0) for s, c in others.items()), F.lit(0))


def best_area(areas: DataFrame, who: str, terms: list[str]) -> DataFrame:
    """[Q4] Of each person the area with the largest share whose name holds all terms; of equals the most specific (level), then by name."""
    fit = reduce(lambda a, b: a & b, (holds(F.lower("area"), t) for t in terms))
    w = Window.partitionBy(who).orderBy(F.desc("share"), F.desc("level"), "area")
    return areas.where(fit).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def ranked_hits(hits: DataFrame, order: str) -> DataFrame:
    """[Q3] Hits with ``position``, from 0: those by other fields first, then those by area alone; within each by share, then by order."""
    alone = F.col("fields") == F.array(F.lit("area"))
    return numbered(hits, [(alone, True), (F.coalesce("share", F.lit(0.0)), False), (F.col(order), True)], "position")


def directory(hits: DataFrame, subject: str | None = None, institution: str | None = None, connected: bool | None = None) -> DataFrame:
    """[Q10] Hits of a subject, an institution, and with or without a group (``groups``, null where no summary is known); None: all."""
    kept = reduce(and_, (F.col(c) == v for c, v in (("subject", subject), ("institution", institution)) if v is not None), F.lit(True))
    return hits.where(kept if connected is None else kept & ((F.col("groups") > 0) == connected))


# What parts a topic query besides white space; endings in s that are no plural; sounds after which a plural takes es.
QUERY_MARKS = ",·/;|"
NO_PLURALS = ("ss", "us", "is")
HISSING = ("ch", "sh", "x", "ss")


def words_of_query(text: str) -> list[str]:
    """[X22] A topic query's words of two characters or more, in the singular: from their first letter or digit to the last one or a hyphen after it."""
    out = []
    for part in unicodedata.normalize("NFKC", text).lower().translate(str.maketrans(dict.fromkeys(QUERY_MARKS, " "))).split():
        kept = [k for k, c in enumerate(part) if c.isalnum()]
        if kept:
            end = max(kept[-1], part.rfind("-"))
            if end + 1 - kept[0] >= 2:
                out.append(singular_word(part[kept[0] : end + 1]))
    return out


def singular_word(word: str) -> str:
    """[X21] Of a query's word, which is on the driver. Words of up to three letters stay; "ies" after a consonant is a "y" in words of five letters or more."""
    bare = word.removesuffix("s")
    if bare == word or len(word) <= 3 or word.endswith(NO_PLURALS):
        return word
    if bare.endswith("ie") and len(word) >= 5 and bare[-3] not in "aeiou":
        return f"{bare[:-2]}y"
    return bare[:-1] if bare.endswith("e") and bare[:-1].endswith(HISSING) else bare


def expanded(terms: list[str], glossary: DataFrame) -> DataFrame:
    """[X22] ``term``, distinct: the terms and, for those in Hangul, what the glossary (word, means: array) says: of the equal word
    or, without one,
    of all words that hold the term or are held by it. Phrases also give their words."""
    korean = [t for t in terms if re.search("[가-힣]", t)]
    plain = glossary.sparkSession.createDataFrame([(t,) for t in terms if t not in korean], "term string")
    near = glossary.withColumn("t", F.explode(F.array(*map(F.lit, korean)).cast("array<string>")))
    near = near.where(F.col("word").contains(F.col("t")) | F.col("t").contains(F.col("word"))).withColumn("equal", F.col("word") == F.col("t"))
    best = near.groupBy("t").agg(F.bool_or("equal").alias("any_equal"))
    meant = near.join(best, "t").where(~F.col("any_equal") | F.col("equal")).select(F.explode("means").alias("term"))
    every = plain.unionByName(meant)
    return every.select(F.explode(F.array_union(F.array("term"), F.split("term", r"\s+"))).alias("term")).distinct()


def query_vector(vocabulary: DataFrame, terms: list[str], most: int = 3) -> DataFrame:
    """[Q7] One row: ``found`` and ``vector``, of unit length (null if nothing is found): the sum over terms of the vector of
    vocabulary's (term, vector) word that is
    the term, else its singular, else the plurals of that; else, for terms of four letters or more, of up to ``most`` words that
    begin with the term, by code point."""
    spark = vocabulary.sparkSession
    ones = {t: singular_word(t) for t in terms}
    forms = [(t, rank, form) for t, one in ones.items() for rank, form in enumerate(dict.fromkeys((t, one, f"{one}s", re.sub("y$", "ies", one))))]
    exact = vocabulary.join(spark.createDataFrame(forms, "asked string, rank int, term string"), "term").groupBy("asked").agg(F.min_by("vector", "rank").alias("vector"))
    long_ = F.array(*(F.lit(t) for t in ones if len(t) >= 4)).cast("array<string>")
    starts = vocabulary.withColumn("asked", F.explode(F.filter(long_, lambda t: F.col("term").startswith(t))))
    w = Window.partitionBy("asked").orderBy("term")
    begun = starts.join(exact.select("asked"), "asked", "left_anti").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("asked", "vector")
    parts = exact.unionByName(begun).select(F.posexplode("vector").alias("i", "v"))
    sums = parts.groupBy("i").agg(F.sum(F.col("v").cast("double")).alias("v"), F.count("*").alias("n"))
    whole = sums.agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"), F.max("n").alias("found"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
    return whole.select(F.coalesce("found", F.lit(0)).alias("found"), F.when(norm > 0, F.transform("s", lambda x: x["v"] / norm)).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def tag_score(tags: Column, terms: list[str]) -> Column:
    """[Q6] The mean over terms of 1 for an equal tag, 0.8 for one that begins with it, 0.5 for one that holds it."""
    one = lambda t: F.when(F.exists(tags, lambda x: x == t), 1.0).when(F.exists(tags, lambda x: x.startswith(t)), 0.8).when(F.exists(tags, lambda x: x.contains(t)), 0.5).otherwise(0.0)
    return sum((one(t) for t in terms), F.lit(0.0)) / len(terms)


def topic_scores(topics: DataFrame, vector: str, tags: str, query_vector: list[float] | None, terms: list[str], least: float = 0.22) -> DataFrame:
    """[Q6, Q7] 0.55 cosine + 0.45 tags, from ``least`` on; tags alone where there is no query vector."""
    by_tag = tag_score(F.col(tags), terms)
    if query_vector is None:
        score = by_tag
    else:
        q = F.array(*(F.lit(float(x)) for x in query_vector))
        score = 0.55 * F.greatest(F.lit(0.0), cosine(F.transform(vector, lambda x: x.cast("double")), q)) + 0.45 * by_tag
    return topics.withColumn("score", score).where(F.col("score") >= least)


def within_group(hits: DataFrame, members: DataFrame, topics: DataFrame, who: str) -> DataFrame:
    """[Q8] Hits of a curated group; members without one get their largest topic that isn't the residual one."""
    own = hits.join(members.select(who).distinct(), who, "left_semi")
    rest = members.select(who).distinct().join(own.select(who).distinct(), who, "left_anti")
    largest = topics.where("topic <> 'Other'").groupBy(who).agg(F.max_by("topic", F.struct("n", "topic")).alias("topic"))
    return own.select(who, "topic").unionByName(rest.join(largest, who).select(who, "topic"))


def series(hits: DataFrame, works: DataFrame, keys: list[str], year: str) -> DataFrame:
    """[Q9] Works by year of the topics that matched."""
    return works.join(hits.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, year).agg(F.count("*").alias("n"))
