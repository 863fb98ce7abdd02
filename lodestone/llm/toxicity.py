"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding maps look-alike letters, accents, full-width and mathematical forms to plain letters, digits and signs that stand for letters
to those letters, all else to blanks. A lexicon entry is a whole word or a word's beginning, with a weight: the log odds of its
documents' labels. A phrase on the list of exceptions takes back what it covers. A document's weights are summed, once over the root
of its number of words and once as a logarithm; a logistic model of both, fitted on the same documents, gives the score.

No word is known beforehand. Entries, exceptions and the model are learned from at most ``LEARN`` labelled documents, chosen by a
hash of their ids, one row
for each id; their counts and measures are all that learning moves, and the bound holds for what reaches the driver. Each term with enough
evidence is an entry. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import modest, staged

#: Labelled documents to learn from, at most.
LEARN = 20_000
#: Beginnings of words that can be entries, in letters.
BEGINNINGS = (4, 5, 6)
#: Twice the log likelihood ratio that an entry or an exception needs.
EVIDENCE = 20.0

# Characters that stand for others.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": " ", "|": " "}
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}


class Fold(dict):
    """A table for str.translate that fills itself."""

    def __missing__(self, code: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        out = "".join(c if SIGNS.get(c, " ") != " " else LOOKALIKES.get(c, c if c.isalnum() else " ") for c in plain) if plain else ""
        self[code] = out
        return out


FOLD = Fold()


_runs = re.compile(f"[{re.escape(''.join(c for c, letter in SIGNS.items() if letter != ' '))}]+")


def _sign(run: re.Match) -> str:
    """A run of signs stands for letters if one is beside it, so numbers stay numbers."""
    t, a, b = run.string, run.start(), run.end()
    beside = (a and t[a - 1].isalpha()) or (b < len(t) and t[b].isalpha())
    return "".join(SIGNS[c] if beside else c if c.isalnum() else " " for c in run[0])


def folded(text: str | None) -> str:
    """Lower case without accents, look-alikes of two alphabets and digits or signs beside letters as the letters that they stand
    for, everything else but numbers a blank; with a blank before and after."""
    return f" {_runs.sub(_sign, (text or '').translate(FOLD))} "


@dataclass
class Model:
    """Entries: " word " or " beginning", with weights."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = field(default=(-3.0, 1.0, 2.0))

    def cached(self):
        """The matcher, made once in each task."""
        if "made" not in self.__dict__:
            self.__dict__["made"] = self.matcher()
        return self.__dict__["made"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "made"}

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight, False))
        for phrase in self.exceptions:
            found.add_word(entry := folded(phrase), (len(entry), 0.0, True))
        if len(found):
            found.make_automaton()
        return found


def uncovered(hits: list[tuple]) -> list[tuple]:
    """The hits (start, end, value, spare) that aren't spare and lie in none that is."""
    spared = sorted((a, b) for a, b, _, spare in hits if spare)
    starts, furthest, far = [a for a, _ in spared], [], -1
    for _, b in spared:
        furthest.append(far := max(far, b))
    out = []
    for hit in hits:
        k = bisect.bisect_right(starts, hit[0]) if not hit[3] else 0
        if not hit[3] and (not k or furthest[k - 1] < hit[1]):
            out.append(hit)
    return out


def measures(text: str | None, matcher) -> tuple[float, float]:
    """The sum of a text's weights over the root of its number of words, and the logarithm of one more than the sum."""
    t = folded(text)
    hits = [(end - size + 1, end, weight, spare) for end, (size, weight, spare) in matcher.iter(t)] if len(matcher) else []
    if not hits:
        return 0.0, 0.0
    total = sum(w for _, _, w, _ in uncovered(hits))
    return total / math.sqrt(1 + len(t.split())), math.log1p(total)


def score_of(found: np.ndarray, model: Model) -> np.ndarray:
    bias, dense, logged = model.coefficients
    return 1 / (1 + np.exp(-(bias + dense * found[:, 0] + logged * found[:, 1])))


def measured(texts: pa.Array, matcher) -> np.ndarray:
    return np.array([measures(x.as_py(), matcher) for x in texts], dtype=np.float64).reshape(-1, 2)


def terms_of(text: str | None) -> set[str]:
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


def phrases_of(text: str | None, matcher) -> set[tuple[str, str]]:
    """(entry, phrase): each entry that the text holds, with the word before or after it, and alone (an empty phrase)."""
    t = folded(text)
    out = set()
    for end, (size, entry, _) in matcher.iter(t) if len(matcher) else ():
        a = end - size + 1
        stop = t.find(" ", a + 1)
        before, word, after = t[max(0, a - 200) : a].split()[-1:], t[a + 1 : stop], t[stop : stop + 200].split()[:1]
        out |= {(entry, ""), *((entry, f"{w} {word}") for w in before), *((entry, f"{word} {w}") for w in after)}
    return out


def counted(rows: DataFrame, of) -> DataFrame:
    """(a, b, toxic, clean): documents of each label that hold the pair of texts, as ``of`` gives a text's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in modest(batches):
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                (toxic if label else clean).update(of(text.as_py()))
        # what clean documents alone hold can't be an entry, but another task may hold toxic ones
        names = list(toxic.keys() | clean.keys())
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.string()), pa.array([y for _, y in some], pa.string()), *(pa.array([n[w] for w in some], pa.int64()) for n in (toxic, clean))], names=["a", "b", "toxic", "clean"])

    return rows.mapInArrow(run, "a string, b string, toxic long, clean long").groupBy("a", "b").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def evidence(a: int, b: int, share: float) -> float:
    """Twice the log likelihood ratio of a toxic and b clean documents against that share of toxic ones."""
    e = (a + b) * share
    return 2 * ((a * math.log(a / e) if a else 0.0) + (b * math.log(b / (a + b - e)) if b else 0.0)) if 0 < share < 1 else 0.0


def lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries by evidence, largest first; one that starts another, or is started by one, that is in already stays out."""
    share = toxic / (toxic + clean)
    ranked = sorted((-evidence(a, b, share), -len(term), term, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))) for term, a, b in counts if a > (a + b) * share)
    chosen: dict[str, float] = {}
    starts: set[str] = set()
    for less, _, term, weight in ranked:
        stem = term.rstrip()
        if -less >= EVIDENCE and weight > 0 and stem not in starts and not any(stem[:n] in chosen or f"{stem[:n]} " in chosen for n in range(2, len(stem) + 1)):
            chosen[term] = weight
            starts.update(stem[:n] for n in range(2, len(stem) + 1))
    return chosen


def exceptions_of(counts: list[tuple[str, str, int, int]]) -> tuple[str, ...]:
    """Phrases that are mostly in clean documents, with evidence that they are so more often than the entry within them."""
    alone = {entry: a / (a + b) for entry, phrase, a, b in counts if not phrase}
    return tuple(sorted({phrase for entry, phrase, a, b in counts if phrase and a < b and a < (a + b) * alone[entry] and evidence(a, b, alone[entry]) >= EVIDENCE}))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, turns: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LEARN) -> Model:
    """A model from the labelled documents for which ``usable`` (of the id, in labels) is true, ``most`` of them at most, those
    whose ids have the smallest hashes.

    Null labels and ids aren't used; of several labels of a document the largest holds, of several texts the smallest. Without both
    labels among them: no
    entries, and for all texts a score by the labels' shares, which is 0.05 without labels.
    """
    chosen = labels.where(usable & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    # the texts to learn from are few; written down, they are looked for in one pass over all texts
    found = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = staged(found.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text"))
    toxic, clean = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    toxic, clean = toxic or 0, clean or 0
    if not toxic or not clean:
        rate = (toxic + 0.5) / (toxic + clean + 10)
        return Model({}, (), (math.log(rate / (1 - rate)), 0.0, 0.0))
    counts = counted(rows, lambda t: {(term, "") for term in terms_of(t)})
    strong = counts.where((F.col("toxic") >= 2) & (F.col("toxic") * clean > F.col("clean") * toxic)).select("a", "toxic", "clean")
    entries = lexicon([tuple(r) for r in strong.collect()], toxic, clean)
    near = counted(rows, lambda t, found=Model({e: e for e in entries}): phrases_of(t, found.cached()))
    model = Model(entries, exceptions_of([tuple(r) for r in near.where((F.col("b") == "") | (F.col("clean") >= 2)).collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches):
            found = measured(b.column(1), model.cached())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["label", "density", "logsum"])

    # sorted here, so that sums over them don't depend on the order of arrival
    got = rows.select("label", "text").mapInArrow(run, "label int, density double, logsum double").toPandas().sort_values(["label", "density", "logsum"])
    model.coefficients = fitted(got[["density", "logsum"]].to_numpy(), got["label"].to_numpy(float))
    return model


def scores(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns and ``score`` of each row. Null, blank and unmatched texts score the model's constant. Rows that repeat are
    scored each. A column of keep
    named score is replaced."""
    keep = [c for c in keep if c != "score"]
    rows = docs.select(*keep, F.col(text).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score_of(measured(b.column(len(keep)), model.cached()), model))], names=[*keep, "score"])

    return rows.mapInArrow(run, docs.select(*keep, F.lit(0.0).alias("score")).schema)


def rejected(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score ``threshold`` or more; all columns as they were, whatever their names."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches):
            yield b.filter(pa.array(score_of(measured(b.column(at), model.cached()), model) < threshold))

    return docs.mapInArrow(run, docs.schema)
