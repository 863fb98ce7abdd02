"""Benchmark decontamination by template windows.

Words are reduced to letters and digits. Numbers, units and names become typed placeholders; a window of five such words is a
template window. An item's windows, plain ones and template ones, are hashed; a document's windows are looked up among them.
A template window with fewer than three plain words says too little and isn't used. Where a document's window fits an item's
by its template, each slot's value in the item must stand for one value in the document, wherever it occurs: a question with other
numbers or names is still that question, a chance fit isn't. A document holds an item if it has three fifths of the item's windows,
or of those of its windows that
are of use as templates, if these are a quarter of all. A capitalised word within a sentence is a name, wherever its text has it
capitalised.

Some items are one window as a whole: those of fewer than five words, which are held where their plain words stand in a row, and
those with too few windows that
are of use as templates, which besides are held where their whole template fits, with three plain words or more and consistent slots.

Documents aren't shuffled. The index goes to all tasks; it is built for so many items at a time that their texts
have at most ``INDEX_BYTES`` bytes, and a larger benchmark takes as many passes, each written before the next one starts, so no task
or driver ever holds two.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import deleted, encoded, modest, split_words, staged, written
from lodestone.operators.numbering import numbered

WINDOW = 5
SHARE = 0.6
PLAIN = 3
#: Of slots whose values must agree.
AGREE = 0.9
INDEX_BYTES = 4 << 20
#: Of rows that a task looks at at once where whole rows pass: words, hashes and places found take many times the texts' bytes.
#: Smaller slices need less memory but repeat more words, which costs time.
SLICE_BYTES = 1 << 18

# Number words and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent mph kmh degrees celsius fahrenheit watt watts volt volts".split())

_DIGITS = re.compile(r"[^\w]*\d[\d.,:/%]*(?:[a-zA-Z%°]{0,3})[^\w]*\Z")
_LETTERS = re.compile(r"[\W_]+")
NUM, UNIT, NAME = (np.uint64(xxhash.xxh64_intdigest(f"<{x}>")) for x in ("number", "unit", "name"))
WORD_, NUMBER_, UNIT_ = 0, 1, 2
#: An odd number and its inverse modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_features(word: str) -> tuple[int, int, bool, bool]:
    """(hash of its letters and digits or 0 if it has none, kind, begins with a capital, ends a sentence)."""
    letters = _LETTERS.sub("", word).lower()
    if not letters:
        return 0, WORD_, False, word[-1:] in ".!?:"
    kind = NUMBER_ if letters in NUMBER_WORDS or _DIGITS.match(word) else UNIT_ if letters in UNITS else WORD_
    first = next((c for c in word if c.isalnum()), "")
    return xxhash.xxh64_intdigest(letters), kind, first.isupper(), word.rstrip("\"')]»”")[-1:] in (".", "!", "?")


_seen: dict[str, tuple] = {}


def features_of(names: list[str]) -> tuple[np.ndarray, ...]:
    if len(_seen) > 1 << 17:
        _seen.clear()
    found = []
    for w in names:
        f = _seen.get(w)
        if f is None:
            f = _seen[w] = word_features(w)
        found.append(f)
    h, kind, cap, ends = zip(*found, strict=True) if found else ((), (), (), ())
    return np.array(h, np.uint64), np.array(kind, np.int8), np.array(cap, bool), np.array(ends, bool)


class Windows:
    """Of many texts: plain and template words (without those of signs only), their texts, and hashes of the windows that start at each."""

    def __init__(self, texts: pa.Array, width: int = WINDOW):
        words, counts = split_words(texts, lower=False)
        codes, self.names = encoded(words)
        h, kind, cap, ends = features_of(self.names)
        text_of = np.repeat(np.arange(len(texts)), counts)
        plain = h[codes] if len(codes) else np.zeros(0, np.uint64)
        after_end = np.ones(len(codes), bool)
        if len(codes):
            after_end[1:] = ends[codes[:-1]] | (text_of[1:] != text_of[:-1])
            big = np.flatnonzero(cap[codes])
            which = text_of[big] * len(self.names) + codes[big]
            named = np.zeros(len(codes), bool)
            named[big[np.isin(which, which[~after_end[big]])]] = True
            template = np.where(kind[codes] == NUMBER_, NUM, np.where(kind[codes] == UNIT_, UNIT, np.where(named, NAME, plain)))
        else:
            template = plain
        full = plain != 0
        self.codes, self.text_of, self.plain, self.template = codes[full], text_of[full], plain[full], template[full]
        self.slot = self.template != self.plain
        n = max(0, len(self.plain) - width + 1)
        whole = self.text_of[:n] == self.text_of[len(self.plain) - n :] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(whole)
        self.by_plain, self.by_template = self._hash(self.plain, n, width)[self.at], self._hash(self.template, n, width)[self.at]
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        self.slots = (slots[width : width + n] - slots[:n])[self.at] if n else np.zeros(0, np.int64)
        self.width = width

    def runs(self, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of so many words within a text start, and their hashes: sums of words' hashes by powers of an odd number, for
        any width at the same cost."""
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(h) - 1, x, np.uint64)), dtype=np.uint64) for x in (BASE, INVERSE))
            sums = np.append(np.uint64(0), np.cumsum(h * up, dtype=np.uint64))
            found = (sums[width:] - sums[:n]) * down[:n]
        at = np.flatnonzero(self.text_of[:n] == self.text_of[width - 1 :])
        return at, found[at] ^ (found[at] >> np.uint64(32))

    @staticmethod
    def _hash(h: np.ndarray, n: int, width: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        return out ^ (out >> np.uint64(32))


class Index:
    """The windows of some items, by hash."""

    def __init__(self, ids: list, texts: list[str], parts: int = 1):
        self.ids, self.parts = ids, parts
        w = Windows(pa.array(texts, pa.string()))
        self.words = [w.names[c] for c in w.codes.tolist()]
        self.total = np.bincount(w.text_of[w.at], minlength=len(ids))
        self.usable = np.bincount(w.text_of[w.at[w.slots <= w.width - PLAIN]], minlength=len(ids))
        starts = np.searchsorted(w.text_of, np.arange(len(ids)))
        self.where: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)  # hash: (item, window, word, by template)
        for at, a, b, slots in zip(w.at.tolist(), w.by_plain.tolist(), w.by_template.tolist(), w.slots.tolist(), strict=True):
            item = int(w.text_of[at])
            self.where[a].append((item, at - int(starts[item]), at, False))
            if slots and slots <= w.width - PLAIN:
                self.where[b].append((item, at - int(starts[item]), at, True))
        self.slot = w.slot
        # items that are one window as a whole: (width, by template): hash: [(item, first word)]
        self.whole: dict[tuple[int, bool], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        sizes = np.bincount(w.text_of, minlength=len(ids))
        slots = np.bincount(w.text_of[w.slot], minlength=len(ids))
        short = np.flatnonzero((sizes > 0) & (sizes < w.width))
        dense = np.flatnonzero((sizes >= w.width) & (4 * self.usable < self.total) & (sizes - slots >= PLAIN))
        for which, by, template in ((short, w.plain, False), (dense, w.template, True)):
            for size in np.unique(sizes[which]).tolist():
                at, hashes = w.runs(by, size)
                at_of = dict(zip(at.tolist(), hashes.tolist(), strict=True))
                for item in which[sizes[which] == size].tolist():
                    self.whole[size, template][at_of[int(starts[item])]].append((item, int(starts[item])))
        #: Hashes of windows that one item has several times.
        self.repeated = {h for h, place in self.where.items() if len(place) > 1 and max(Counter((item, t) for item, _, _, t in place).values()) > 1}
        keys = np.array(list(self.where), np.uint64)
        self.bits = max(16, min(24, int(len(keys)).bit_length() + 7))
        self.there = np.zeros(1 << self.bits, bool)
        self.there[(keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.there[(h & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        return at[[x in self.where for x in h[at].tolist()]] if len(at) else at

    def held(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, windows of the item that the text has, by their plain words, all windows, slots with another value) of each
        held item."""
        w = Windows(texts)
        found: dict[tuple[int, int], dict] = defaultdict(lambda: {"plain": set(), "template": set(), "slots": Counter(), "distances": [], "several": []})

        def hold(pair: dict, at: int, word: int) -> None:
            for d in range(w.width):
                if self.slot[word + d]:
                    pair["slots"][self.words[word + d], w.names[w.codes[at + d]]] += 1

        for by, template in ((w.by_plain, False), (w.by_template, True)):
            for k in self.hits(by).tolist():
                at, place = int(w.at[k]), self.where[int(by[k])]
                several = int(by[k]) in self.repeated
                for item, window, word, of_template in place:
                    if of_template == template:
                        pair = found[int(w.text_of[at]), item]
                        pair["template" if template else "plain"].add(window)
                        if several:
                            pair["several"].append((at, template, word))
                        else:
                            pair["distances"].append(at - word)
                            hold(pair, at, word)
        for pair in found.values():
            if pair["several"]:
                # a clause that an item repeats fits several of its windows: a place's slots are held against the one whose distance
                # most places share
                votes = Counter(pair["distances"])
                votes.update(at - word for at, _, word in pair["several"])
                best: dict[tuple[int, bool], int] = {}
                for at, template, word in pair["several"]:
                    if (at, template) not in best or (votes[at - word], word) > (votes[at - best[at, template]], best[at, template]):
                        best[at, template] = word
                for (at, _), word in best.items():
                    hold(pair, at, word)
        out = []
        for (text, item), pair in sorted(found.items()):
            both = pair["plain"] | pair["template"]
            least = SHARE * (self.usable[item] if 4 * self.usable[item] >= self.total[item] else self.total[item])
            if len(both) < max(1, least):
                continue
            values: dict[str, Counter] = defaultdict(Counter)
            for (there, here), n in pair["slots"].items():
                values[there][here] += n
            agree, all_ = sum(max(c.values()) for c in values.values()), sum(pair["slots"].values())
            if len(pair["plain"]) >= least or agree >= AGREE * all_:
                changed = sum(c.most_common(1)[0][0] != there for there, c in values.items())
                out.append((text, item, len(both), len(pair["plain"]), int(self.total[item]), changed))
        known = {(text, item) for text, item, *_ in out}
        for text, item, plain, changed in self.held_whole(w):
            if (text, item) not in known:
                known.add((text, item))
                out.append((text, item, 1, plain, 1, changed))
        return sorted(out)

    def looked_up(self, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        """The batches in slices of about ``SLICE_BYTES``, and what the texts of each, in column ``at``, hold."""
        for b in modest(batches, size=SLICE_BYTES):
            yield b, self.held(b.column(at))

    def held_whole(self, w: Windows) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, 1 if by its plain words, slots with another value) for each place that holds an item that is one window."""
        for (size, template), where in self.whole.items():
            at, hashes = w.runs(w.template if template else w.plain, size)
            for k in np.flatnonzero(np.isin(hashes, np.array(list(where), np.uint64))).tolist():
                for item, first in where[int(hashes[k])]:
                    values: dict[str, Counter] = defaultdict(Counter)
                    for d in range(size):
                        if template and self.slot[first + d]:
                            values[self.words[first + d]][w.names[w.codes[at[k] + d]]] += 1
                    if sum(max(c.values()) for c in values.values()) >= AGREE * sum(map(Counter.total, values.values())):
                        changed = sum(c.most_common(1)[0][0] != there for there, c in values.items())
                        yield int(w.text_of[at[k]]), item, int(not changed), changed


def numbered_items(benchmark: DataFrame, text: str) -> DataFrame:
    """(rep, text): the different texts of the benchmark, numbered."""
    return staged(numbered(benchmark.select(F.col(text).alias("text")).where("text is not null").distinct(), [(F.col("text"), True)], "rep"))


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """One for so many different texts at a time, by their numbers."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / index_bytes))
    for k in range(parts):
        some = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()
        if some:
            yield Index([r["rep"] for r in some], [r["text"] for r in some], parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, n_windows (of the item), n_matched, n_plain, n_changed (slots with
    other values), kind (``verbatim`` or ``template``).

    An item without words is held by none, a document without words holds none. Null texts are empty. Null ids are carried. Rows
    that repeat give rows that repeat.
    """

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "doc_id long, rep long, n_windows long, n_matched long, n_plain long, n_changed long, kind string"
    out = None
    items = numbered_items(benchmark, item_text)
    for index in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in modest(batches):
                if held := index.held(b.column(1)):
                    ids = b.column(0).to_pylist()
                    cells = [(ids[t], index.ids[i], total, n, plain, changed, "verbatim" if plain >= SHARE * total else "template") for t, i, n, plain, total, changed in held]
                    types = [pa.int64()] * 6 + [pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)], names=kind.replace(" long", "").replace(" string", "").split(", "))

        some = rows.mapInArrow(run, kind)
        some = staged(some) if index.parts > 1 else some
        out = some if out is None else out.unionByName(some)
    out = out if out is not None else docs.sparkSession.createDataFrame([], kind)
    # texts that several rows of the benchmark share were looked up once
    ids = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).join(items, "text").select("rep", "item_id")
    return out.join(ids, "rep").select("doc_id", "item_id", "n_windows", "n_matched", "n_plain", "n_changed", "kind")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold an item; all columns as they were."""

    at, before = docs.columns.index(text), None
    for index in indexes(numbered_items(benchmark, item_text)):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b, held in index.looked_up(batches, at):
                clean = np.ones(b.num_rows, bool)
                clean[[t for t, *_ in held]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if index.parts > 1:
            path, (docs, now) = before, written(docs)
            before = now
            if path:
                deleted(docs.sparkSession, path)
    return docs
