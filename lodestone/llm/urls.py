"""URL filtering by association rules.

A URL is a basket of tokens: its host, the host's ends and labels, its path's segments, words of these, its query's keys. Spark's FP-growth
mines the baskets of bad labelled pages for token combinations that many of them share; one pass over all labelled pages counts these. Rules
are pruned by support and confidence, and a rule goes if a part of it does as well. They match by an inverted index from token to
rules: a rule holds
if as many of its tokens were met as it has. Before that, fixed rules of host and path decide; of those that fit the longest.

FP-growth lists all parts of a frequent basket, of any length, two to the power of its width. Where a page has more than ``WIDE``
frequent tokens, it is
left to a search level by level, which ends at ``LENGTH`` tokens and finds the same; so long URLs lose no token and cost no power.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, modest, staged

#: A combination's least share of labelled pages, and a rule's least share of bad ones among those that it matches.
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Tokens of a rule, at most. With SUPPORT, that bounds the number of rules: a page has a bounded number of combinations of so many
#: frequent tokens.
LENGTH = 3
#: Frequent tokens of a page that FP-growth mines, at most.
WIDE = 12

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SPLIT = re.compile(r"[^a-z0-9]+")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """rules: (verdict, host, path). The longest that fits, as (rule, verdict), or null."""
    chain = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(host: str, path: str, url: str) -> list[str]:
    parts = [p for p in host.split(":")[0].split(".") if p]
    out = {f"host:{host}"} | {f"end:{'.'.join(parts[k:])}" for k in range(1, len(parts))} | {f"name:{p}" for p in parts[:-1]}
    out |= {f"word:{w}" for p in parts[:-1] for w in _SPLIT.split(p) if w} if any("-" in p for p in parts) else set()
    for segment in filter(None, path.lower().split("/")):
        out |= {f"path:{w}" for w in _SPLIT.split(segment) if w and not w.isdigit()}
    query = url.partition("?")[2].partition("#")[0] if "?" in url else ""
    out |= {f"key:{k.partition('=')[0].lower()}" for k in query.split("&") if k}
    return sorted(out)


def baskets(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns and ``tokens``. pages has host, path and url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches, 4096):
            host, path, url = (b.column(len(keep) + k).to_pylist() for k in range(3))
            found = [tokens_of(h, p, u or "") if h or p else [] for h, p, u in zip(host, path, url, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, pa.list_(pa.string()))], names=[*keep, "tokens"])

    rows = pages.select(*keep, "host", "path", "url")
    return rows.mapInArrow(run, rows.select(*keep, F.array(F.lit("")).alias("tokens")).schema)


def levels(baskets_: DataFrame, least: float, length: int) -> set[tuple[str, ...]]:
    """The combinations of up to ``length`` tokens that at least so many baskets hold. Each round extends what the one before it found."""
    found: set[tuple[str, ...]] = set()
    parts: set[tuple[str, ...]] = {()}
    for size in range(1, length + 1):
        used = {t for part in parts for t in part}

        def counted(batches: Iterator[pa.RecordBatch], size=size, parts=parts, used=used) -> Iterator[pa.RecordBatch]:
            for b in modest(batches, 4096):
                n = Counter()
                for tokens in b.column(0).to_pylist():
                    own = sorted({t for t in tokens if size == 1 or t in used})
                    heads = [()] if size == 1 else [c for c in itertools.combinations(own, size - 1) if c in parts]
                    sets = ((*c, t) for c in heads for t in own if not c or t > c[-1])
                    n.update(c for c in sets if size < 3 or all(c[:k] + c[k + 1 :] in parts for k in range(size)))
                yield pa.RecordBatch.from_arrays([pa.array(list(map(list, n)), pa.list_(pa.string())), pa.array(list(n.values()), pa.int64())], names=["items", "n"])

        sums = baskets_.select("tokens").mapInArrow(counted, "items array<string>, n long").groupBy("items").agg(F.sum("n").alias("n"))
        parts = {tuple(r["items"]) for r in sums.where(F.col("n") >= least).collect()}
        found |= parts
        if not parts:
            break
    return found


def postings(sets: list[tuple[str, ...]]) -> dict[str, list[int]]:
    index: dict[str, list[int]] = defaultdict(list)
    for k, tokens in enumerate(sets):
        for t in tokens:
            index[t].append(k)
    return index


def held(tokens: list[str], sets: list[tuple[str, ...]], index: dict[str, list[int]]) -> list[int]:
    """Which of the sets the tokens hold."""
    met = Counter(k for t in tokens for k in index.get(t, ()))
    return [k for k, n in met.items() if n == len(sets[k])]


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, length: int = LENGTH, wide: int = WIDE) -> list[tuple[tuple[str, ...], float, float]]:
    """(tokens, confidence, support) of each rule. labelled: tokens, bad (boolean). A combination that too few bad pages hold is no
    rule, so they are mined, then all counted."""
    labelled = staged(labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select(F.array_distinct("tokens").alias("tokens"), "bad"))
    n = labelled.count()
    if not n:
        return []
    least = max(3.0, support * n) - 1e-9
    bad = labelled.where("bad")
    frequent = frozenset(r["t"] for r in bad.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") >= least).collect())

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array([[t for t in tokens if t in frequent] for tokens in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["tokens"])

    shared = staged(bad.select("tokens").mapInArrow(often, "tokens array<string>").where(F.size("tokens") > 0))
    narrow = shared.where(F.size("tokens") <= wide)
    k, all_ = narrow.count(), shared.count()
    sets = set()
    if k >= least:
        found = FPGrowth(itemsCol="tokens", minSupport=least / k).fit(narrow).freqItemsets
        sets = {tuple(sorted(r["items"])) for r in found.where(F.size("items") <= length).select("items").collect()}
    if k < all_:
        sets |= levels(shared, least, length)
    sets = sorted(sets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = postings(sets)
        for b in modest(batches, 4096):
            n, bad_n = Counter(), Counter()
            for tokens, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = held(tokens, sets, index)
                n.update(own)
                if bad:
                    bad_n.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([bad_n[c] for c in n], pa.int64())], names=["k", "n", "bad"])

    sums = labelled.select("tokens", "bad").mapInArrow(counted, "k int, n long, bad long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    strong = [(sets[r["k"]], r["bad"] / r["n"], r["bad"] / n) for r in sums.where((F.col("bad") >= least) & (F.col("bad") >= confidence * F.col("n"))).collect()]
    chosen: dict[tuple[str, ...], tuple[float, float]] = {}
    for tokens, conf, supp in sorted(strong, key=lambda r: (len(r[0]), r[0])):
        parts = (c for size in range(1, len(tokens)) for c in itertools.combinations(tokens, size))
        if not any(c in chosen and chosen[c][0] >= conf for c in parts):
            chosen[tokens] = conf, supp
    return [(t, c, s) for t, (c, s) in chosen.items()]


def matched(pages: DataFrame, rules: list[tuple[tuple[str, ...], float, float]], keep: list[str]) -> DataFrame:
    """keep's columns and ``confidence``, the largest of the rules that hold, or null. pages has host, path and url."""
    sets = [tokens for tokens, _, _ in rules]
    index = postings(sets)

    def best(tokens: list[str]) -> float | None:
        return max((rules[k][1] for k in held(tokens, sets, index)), default=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches, 4096):
            host, path, url = (b.column(len(keep) + k).to_pylist() for k in range(3))
            found = [best(tokens_of(h, p, u or "")) if h or p else None for h, p, u in zip(host, path, url, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, pa.float64())], names=[*keep, "confidence"])

    rows = pages.select(*keep, "host", "path", "url")
    return rows.mapInArrow(run, rows.select(*keep, F.lit(None).cast("double").alias("confidence")).schema)


def judged(pages: DataFrame, labelled: DataFrame, fixed: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """id, host, path, rule, verdict and confidence of each page. labelled: url, bad (boolean).

    A null url, or one without "://", has an empty host and path; no mined rule holds for it, so it is allowed. Null labels aren't
    used. Null
    ids are carried; rows that repeat are judged each. Without labelled pages the method allows all.
    """
    split = lambda df: df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rules = mined(baskets(split(labelled.select("url", "bad")), ["bad"]), support, confidence)
    rows = split(pages.select(F.col(page_id).alias("id"), F.col(url).alias("url")))
    found = matched(rows.select("id", "host", "path", "url"), rules, ["id", "host", "path"])
    decided = found.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    method = F.when(F.col("confidence") >= confidence, "block").otherwise("allow")
    return decided.select("id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", method).alias("verdict"), "confidence")
