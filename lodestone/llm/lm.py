"""Language-model scoring by a weighted backoff automaton whose n-grams are counted over the whole corpus.

The model is an n-gram model with hierarchical Dirichlet smoothing, read as an automaton:

* a state is a context (the empty one, one word, two words);
* the arc of state ``u`` by word ``w`` weighs ``(c(uw) + mu * p(w | shorter u)) / (c(u) + mu)``;
* where ``u`` has no such arc, its failure arc weighs ``mu / (c(u) + mu)`` and leads to the state of the context without
  its first word; the state without context always answers, with ``(c(w) - D) / N`` or, for all unknown words together,
  ``D * V / N``. ``D = n1 / (n1 + 2 * n2)`` from the counts of words seen once and twice.

A text is one pass from left to right that carries the state: each token adds the log of its arc's weight and of those of the
failure arcs before it.

The model never has to fit one machine. Texts are cut into blocks of a bounded number of tokens. A block sends the hash of
each of its n-grams, once, to one of many buckets; a bucket adds up the counts of all blocks and answers each block with
what the others have seen of just the n-grams that it asked for. So a block gets the part of the automaton that its own texts can
reach, compiles
it into arrays and walks all its texts through it. Two shuffles, both dealt evenly by hash: a frequent n-gram costs one entry
for each block. The lineage is linear and each step a function of its input, so that a lost executor repeats only its own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import encoded, mixed, modest, parallelism, split_words

ORDER = 3
#: Strength of the shorter context's vote, by the length of the n-gram.
MU = {2: 2000.0, 3: 3.0}
#: Tokens of a block; a block's arrays take some 100 bytes a token while it is worked on.
BLOCK_TOKENS = 2_000_000
#: Words of a block that get the smallest codes, by frequency, which compress; the others go by hash, as the buckets' answers give them.
FREQUENT = 4096

#: Bits of an n-gram's hash, but for single words, which have 64. Of n different n-grams, one in 2 ** 56 / n shares its hash with another.
HASH_BITS = 56

#: The end of a text, which is no word as it holds a blank. It also stands before the first word.
END = np.uint64(xxhash.xxh64_intdigest(b" end "))

ROWS = pa.schema([("to", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: those of one weight side by side, then compressed."""
    out, zstd = [], pa.Codec("zstd", compression_level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        body = zstd.compress(planes, asbytes=True) if planes else b""
        out += [np.array([len(a), len(body)], np.int64).tobytes(), a.dtype.str.encode().ljust(8), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at, zstd = [], 0, pa.Codec("zstd")
    while at < len(data):
        n, size = np.frombuffer(data, np.int64, 2, at)
        kind = np.dtype(data[at + 16 : at + 24].decode().strip())
        raw = zstd.decompress(data[at + 24 : at + 24 + size], int(n) * kind.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += 24 + int(size)
    return out


def packed_hashes(h: np.ndarray) -> np.ndarray:
    """Ascending hashes as differences, which compress."""
    return np.diff(h, prepend=np.uint64(0))


def bucket_of(h: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Ascends with the hash."""
    return ((h >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def seen_in(grams: "Grams", learned: np.ndarray) -> list[np.ndarray]:
    """How often each n-gram of a block occurs in its training texts."""
    return [np.bincount(at[(at >= 0) & learned], minlength=len(h)).astype(np.uint32) for h, at in zip(grams.hashes, grams.at, strict=True)]


class Grams:
    """The n-grams of a block: for each order the sorted hashes of the different ones, and for each token which of them ends there
    (-1: none)."""

    def __init__(self, words: np.ndarray, codes: np.ndarray, first: np.ndarray, order: int):
        """words: hash of each code; codes: of all tokens, ends included; first: whether a token is the first of its text."""
        self.hashes, self.at = [], []
        size = len(words)
        end = int(np.flatnonzero(words == END)[0]) if size else 0
        own, ids = words, codes.astype(np.int64)
        since = np.arange(len(codes)) - np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0)) if len(codes) else codes
        for n in range(1, order + 1):
            if n > 1:
                before = np.empty_like(ids)
                before[1:] = ids[:-1]
                before[:1] = -1
                before[first] = end if n == 2 else -1
                there = before >= 0
                keys, back = np.unique(before[there] * size + codes[there], return_inverse=True)
                own = mixed(own[keys // size], words[keys % size]) >> np.uint64(64 - HASH_BITS)
                ids = np.full(len(codes), -1, np.int64)
                ids[there] = back
                del keys, back, before, there
            by = np.argsort(own, kind="stable")
            place = np.empty(len(by) + 1, np.int32)
            place[by] = np.arange(len(by), dtype=np.int32)
            place[-1] = -1  # no n-gram ends there
            self.hashes.append(own[by])
            self.at.append(place[ids])
        self.since = since


def coded(n: int, top: np.ndarray) -> np.ndarray:
    """Which of n words each code stands for: first the top ones, then the rest in their order."""
    rest = np.ones(n, bool)
    rest[top] = False
    return np.concatenate([top.astype(np.int64), np.flatnonzero(rest)])


def blocks_of(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple]:
    """(ids, null ids, training, words of each text, ascending hashes of the different words, the most frequent of them, codes) of
    up to so many tokens, or of one longer text."""
    held: list[tuple] = []
    n = 0

    def done() -> tuple:
        ids, null, train, counts, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        words, codes, times = np.unique(hashes, return_inverse=True, return_counts=True)
        top = np.argsort(-times, kind="stable")[:FREQUENT]
        by = coded(len(words), top)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        return ids, null, train, counts, words, top.astype(np.uint32), place[codes]

    for batch in modest(batches):
        words, counts = split_words(batch.column("text"))
        codes, names = encoded(words)
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
        ends = np.cumsum(counts + 1)
        hashes = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        is_end = np.zeros(len(hashes), bool)
        is_end[ends - 1] = True
        hashes[is_end] = END
        hashes[~is_end] = own[codes] if len(codes) else own
        null = batch.column("id").is_null().to_numpy(zero_copy_only=False)
        ids = batch.column("id").fill_null(0).to_numpy()
        train = batch.column("training").to_numpy(zero_copy_only=False).astype(bool)
        at = 0
        while at < len(ids):  # as many texts as the block still holds
            room = tokens - n + (ends[at - 1] if at else 0)
            to = max(at + (not held), int(np.searchsorted(ends, room, "right")))
            a, b = (int(ends[at - 1]) if at else 0), (int(ends[to - 1]) if to else 0)
            if to > at:
                held.append((ids[at:to], null[at:to], train[at:to], counts[at:to] + 1, hashes[a:b]))
                n += b - a
                at = to
            if at < len(ids) or n >= tokens:
                yield done()
                held, n = [], 0
    if held:
        yield done()


def text_starts(counts: np.ndarray) -> np.ndarray:
    first = np.zeros(int(counts.sum()), bool)
    first[np.cumsum(counts) - counts] = True
    return first


def home(block: int, buckets: int) -> int:
    """Where a block is scored: the k-th blocks of neighbouring tasks go to neighbouring buckets, so equal tasks fill all buckets evenly."""
    return ((block >> 24) + (block & 0xFFFFFF)) % buckets


def batched(rows: list[tuple], size: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + size], strict=True), ROWS.types, strict=True)], schema=ROWS)


def ask(buckets: int, order: int, tokens: int):
    """Texts to rows: a block's own texts, which travel to where they are scored, and its n-grams and their counts for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, (ids, null, train, counts, words, top, codes) in enumerate(blocks_of(batches, tokens)):
            block = (part << 24) + k
            grams = Grams(words[coded(len(words), top)], codes, text_starts(counts), order)
            learned = np.repeat(train, counts)
            seen = seen_in(grams, learned)
            cuts = [np.searchsorted(bucket_of(h, buckets, HASH_BITS if n else 64), np.arange(buckets + 1)) for n, h in enumerate(grams.hashes)]
            grams.at.clear()
            codes_kind = np.uint32 if len(words) > 1 << 16 else np.uint16
            rows = [(home(block, buckets), block, -1, pack(ids, null, train, counts.astype(np.uint32), top, codes.astype(codes_kind)))]
            rows += [(b, block, b, pack(*(x for h, c, cut in zip(grams.hashes, seen, cuts, strict=True) for x in (packed_hashes(h[cut[b] : cut[b + 1]]), c[cut[b] : cut[b + 1]])))) for b in range(buckets)]
            del grams, seen
            yield from batched(rows)

    return run


def answer(buckets: int, order: int):
    """Rows of a bucket to how often the other blocks saw what each block asked for, after the hashes of its words and the bucket's
    share of N, V, n1 and n2. Texts pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[int, bytes]]] = {}
        for batch in modest(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for _, block, bucket, body in rows:
                if bucket < 0:
                    yield from batched([(home(block, buckets), block, -1, body)])
                else:
                    asked.setdefault(bucket, []).append((block, body))
        for bucket, rows in asked.items():
            rows.sort(key=lambda x: x[0])
            parts = [unpack(body) for _, body in rows]
            replies: list[list[np.ndarray]] = [[] for _ in rows]
            share = np.zeros(4, np.int64)
            for n in range(order):
                with np.errstate(over="ignore"):
                    keys = [np.cumsum(p[2 * n], dtype=np.uint64) for p in parts]
                _, back = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(back, weights=np.concatenate([p[2 * n + 1] for p in parts])).astype(np.uint64) if len(back) else np.zeros(0, np.uint64)
                if n == 0:
                    words = [p[0] for p in parts]
                    share = np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64)
                at = 0
                for reply, k, p in zip(replies, keys, parts, strict=True):  # what the others have seen, which is mostly nothing
                    others = total[back[at : at + len(k)]] - p[2 * n + 1]
                    reply.append(others.astype(np.uint32 if not len(others) or others.max() < 1 << 32 else np.uint64))
                    at += len(k)
            yield from batched([(home(block, buckets), block, bucket, pack(share, own, *reply)) for (block, _), own, reply in zip(rows, words, replies, strict=True)])

    return run


class Automaton:
    """A block's part of the model, compiled into arrays.

    States are numbered: 0 is the state without context, then come the block's words, then its pairs of words. An arc is an n-gram
    that was seen, from the state of its first
    n - 1 words by its last word to the state of its last ORDER - 1 words; ``origin`` and ``target`` hold its ends, ``weight`` its
    log10 probability. ``failure`` holds for each state
    where its failure arc leads, ``cost`` that arc's weight. A state is reached only by arcs, so contexts that were never seen have none.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], share: np.ndarray, mu: dict[int, float]):
        self.grams, self.totals = grams, totals
        self.n, self.v, n1, n2 = (int(x) for x in share)
        self.discount = min(0.999, max(0.001, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        order = len(totals)
        #: The first state of contexts of each length.
        self.base = np.concatenate([[0, 1], 1 + np.cumsum([len(t) for t in totals[: order - 1]])]).astype(np.int64)
        self.first = np.flatnonzero(grams.since == 0)
        before = np.full(len(grams.at[0]), -1, np.int32)
        self.origin, self.target, self.weight = [], [], []
        failure, cost = [np.zeros(1, np.int32)], [np.zeros(1)]
        lower = shorter = np.zeros(0)
        for k in range(order):
            at, count = grams.at[k], totals[k].astype(np.float64)
            there = at >= 0
            origin, part = np.zeros(len(count), np.int32), np.zeros(len(count), np.int32)  # of each n-gram: its state, and the (n - 1)-gram of its last words
            if k == 0:
                p = np.where(count > 0, (count - self.discount) / max(self.n, 1), self.discount * self.v / self.n if self.n else 1.0)
            else:
                before[1:] = grams.at[k - 1][:-1]
                before[self.first] = self.end if k == 1 else -1
                origin[at[there]], part[at[there]] = before[there], grams.at[k - 1][there]
                p = (count + mu[k + 1] * lower[part]) / (shorter[origin] + mu[k + 1])
                origin += np.int32(self.base[k])
            kept = k + 1 < order
            state = np.arange(len(count), dtype=np.int32) + np.int32(self.base[k + 1]) if kept else part + np.int32(self.base[k])
            self.origin.append(origin)
            self.target.append(np.where(count > 0, state, np.int32(0)))
            self.weight.append(np.log10(p))
            if kept:
                failure.append(part + np.int32(self.base[k]) if k else np.zeros(len(count), np.int32))
                cost.append(np.log10(mu[k + 2] / (count + mu[k + 2])))
            lower, shorter = p, count
        self.failure, self.cost = np.concatenate(failure), np.concatenate(cost)

    @property
    def end(self) -> int:
        """The end as a word."""
        last = np.append(self.grams.since[1:] == 0, True)
        return int(self.grams.at[0][last][0]) if len(last) and len(self.grams.since) else -1

    def seen(self, order: int) -> np.ndarray:
        at = self.grams.at[order - 1]
        return np.where(at >= 0, self.totals[order - 1][at], 0).astype(np.float64) if len(self.totals[order - 1]) else np.zeros(len(at))

    def walk(self, piece: int = 256) -> np.ndarray:
        """The log10 weight of each token's path: its arc's and those of the failure arcs before it. One pass from left to right
        that carries the state, over many
        pieces of texts side by side. A piece within a text starts ORDER - 1 tokens early, after which its state is the text's, as
        no state is longer."""
        size, order = len(self.grams.since), len(self.totals)
        out = np.zeros(size)
        if not size:
            return out
        since = self.grams.since
        starts = np.flatnonzero((since == 0) | (since % piece == 0))
        early = np.minimum(since[starts], order - 1)
        steps = np.diff(np.append(starts, size)) + early
        by = np.argsort(-steps, kind="stable")  # longest first, so that those still under way are a slice
        starts, early, steps = starts[by], early[by], steps[by]
        state = np.where(since[starts] == early, self.target[0][self.end], np.int32(0))  # the end before a text's first word is a context like any other
        for step in range(int(steps[0])):
            n = int(np.searchsorted(-steps, -step, "left"))
            at = starts[:n] - early[:n] + step
            now, total, to = state[:n].copy(), np.zeros(n), np.full(n, -1, np.int32)
            for k in range(order - 1, -1, -1):  # from the longest context on, along failure arcs
                arc = self.grams.at[k][at]
                here = (to < 0) & (now >= self.base[k])
                hit = here & (arc >= 0)
                hit[hit] = (self.origin[k][arc[hit]] == now[hit]) & ((self.totals[k][arc[hit]] > 0) | (k == 0))
                total[hit] += self.weight[k][arc[hit]]
                to[hit] = self.target[k][arc[hit]]
                miss = here & ~hit
                total[miss] += self.cost[now[miss]]
                now[miss] = self.failure[now[miss]]
            state[:n] = to
            new = step >= early[:n]
            out[at[new]] = total[new]
        return out


def score(order: int, mu: dict[int, float]):
    """A block's texts and all buckets' answers to one row for each text. Rows come sorted by block, so a task holds one block at a time."""

    def scored(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        (_, body), *rows = sorted(rows)  # a block's texts have bucket -1
        ids, null, train, counts, top, codes = unpack(body)
        counts, codes = counts.astype(np.int64), codes.astype(np.int64)
        replies = [unpack(body) for _, body in rows]
        share = np.sum([r[0] for r in replies], axis=0)
        words = np.concatenate([np.cumsum(r[1], dtype=np.uint64) for r in replies])
        grams = Grams(words[coded(len(words), top)], codes, text_starts(counts), order)
        own = seen_in(grams, np.repeat(train.astype(bool), counts))
        totals = [np.concatenate([r[2 + n] for r in replies]) + own[n] for n in range(order)]
        del replies, own, words
        grams.hashes.clear()  # of no more use
        model = Automaton(grams, totals, share, mu)
        known = model.seen(1)
        starts = np.cumsum(counts) - counts
        base = np.log10((known + 1) / (model.n + model.v + 1))
        sums = [np.add.reduceat((known > 0).astype(np.int64), starts), np.full(len(ids), model.n), np.add.reduceat(base, starts), np.add.reduceat(model.walk(), starts)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null.astype(bool)), pa.array(train.astype(bool)), pa.array(counts), *(pa.array(x) for x in sums)],
            names=["id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in modest(batches):
            for _, block, bucket, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at and held:
                    yield scored(held)
                    held = []
                at = block
                held.append((bucket, body))
        if held:
            yield scored(held)

    return run


def backoff_scores(docs: DataFrame, doc_id: str, text: str, training: F.Column, order: int = ORDER, mu: dict[int, float] | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """id, training, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (log10 probability by the
    automaton) of each row, learned from the rows for which ``training`` is true.

    A null or empty text is its end alone. A null id stays null. A null ``training`` counts as false. Rows that repeat are scored
    each. Without training
    rows all probabilities are 1. Other columns are not read. No row: no row.
    """
    spark = docs.sparkSession

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text).alias("text"))
    buckets = parallelism(rows)
    kind = "to int, block long, bucket int, body binary"
    asked = rows.mapInArrow(ask(buckets, order, block_tokens), kind)
    answered = asked.repartitionById(buckets, F.col("to")).mapInArrow(answer(buckets, order), kind)
    homes = answered.repartitionById(buckets, F.col("to")).sortWithinPartitions("block")
    return homes.mapInArrow(score(order, mu or MU), "id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
