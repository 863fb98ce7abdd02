"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance by the generalised pigeonhole principle.

Fingerprints are cut into partitions of bits; bits that go together over the data share a partition. With thresholds t_i that
sum up to (distance - partitions + 1), each linked pair is within t_i in at least one partition i. Thresholds need not be equal:
dynamic programming chooses them, and the number of partitions, for the fewest expected candidates, from exact counts over all
fingerprints. Each fingerprint is filed under its own bits of a partition and probes all values within the partition's threshold;
candidates are verified on all 64 bits.

No pair is lost and no bucket is squared. Copies with one fingerprint count once. A bucket of more than ``BUCKET`` fingerprints
isn't paired: its fingerprints meet at the points within half the distance around them instead. Two fingerprints at a distance of 2
or less have such a point in common, at most 65 fingerprints share one, and those there are linked to the smallest in a star.
(For other distances such buckets are cut by further bits first.)
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import deleted, mixed, modest, packed, staged, unpacked, written

BITS = 64
#: Fingerprints in a bucket that are compared pair by pair.
BUCKET = 128


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Of the lower-cased (A-Z) words' shingles, repeats included; of all words, if they are fewer; 0 if there are none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= shingle:
        hashes, k = xxhash.xxh64_digest(whole, seed), 1
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        digest, k = xxhash.xxh64_digest, n - shingle + 1
        hashes = b"".join([digest(whole[a:b], seed) for a, b in zip((ends - size)[:k].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    count = np.zeros(BITS, np.int64)
    bits = np.frombuffer(hashes, np.uint8).reshape(k, 8)
    for at in range(0, k, 1 << 16):
        count += np.unpackbits(bits[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > k).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str, keep: list[str], shingle: int = 3) -> DataFrame:
    """keep's columns and ``fp``, the fingerprint as a long. A null or blank text has fingerprint 0."""

    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches):
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column("__text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], names=[*keep, "fp"])

    return rows.mapInArrow(run, rows.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and how many have bits i and j set. Exact; 2,080 sums reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for b in modest(batches):
            bits = np.unpackbits(b.column("fp").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            both += (bits.T @ bits).astype(np.float64)
            n += b.num_rows
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(both[i, j], n).astype(np.int64))], names=["ij", "n"])

    sums = {r["ij"]: r["n"] for r in fps.select("fp").mapInArrow(run, "ij long, n long").groupBy("ij").agg(F.sum("n").alias("n")).collect()}
    both = np.zeros((BITS, BITS))
    for ij, n in sums.items():
        if ij >= 0:
            both[ij // BITS, ij % BITS] = both[ij % BITS, ij // BITS] = n
    return int(sums.get(-1, 0)), both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in so many groups of about one size, each bit next to the bit that it goes with most."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    together = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(together, -1)
    left, chain = set(range(BITS)), [int(np.unravel_index(together.argmax(), together.shape)[0])]
    left.discard(chain[0])
    while left:
        chain.append(max(left, key=lambda b: (together[chain[-1], b], -b)))
        left.discard(chain[-1])
    cuts = [round(BITS * k / parts) for k in range(parts + 1)]
    return [sorted(chain[a:b]) for a, b in itertools.pairwise(cuts)]


def expected(n: int, same: float, flips: np.ndarray, most: int) -> list[float]:
    """Cost of a partition for each threshold 0..most: rows filed and probed, and candidate pairs. same: pairs that agree on all its bits,
    counted exactly; flips: odds that a bit differs, from which those that differ by one or more bits follow."""
    agree = np.prod(1 - flips)
    near = np.zeros(most + 1)
    near[0] = 1
    for q in flips:
        near[1:] = near[1:] * (1 - q) + near[:-1] * q
        near[0] *= 1 - q
    grown = np.cumsum(near) / max(agree, 1e-300)
    return [n * sum(math.comb(len(flips), k) for k in range(t + 1)) + same * grown[t] for t in range(most + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, one for each partition and -1 at least, that sum up to total at the least cost. -1: the partition isn't used."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for done, (sum_, chosen) in best.items():
            for t in range(-1, len(cost)):
                c = sum_ + (cost[t] if t >= 0 else 0.0)
                if done + t not in now or c < now[done + t][0]:
                    now[done + t] = (c, [*chosen, t])
        best = now
    return best.get(total, (math.inf, []))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bits_of(fp, bits: list[int]):
    """The bits' values, packed into a long. Neighbouring bits move together."""
    out, at = F.lit(0).cast("long"), 0
    for _, run in itertools.groupby(enumerate(bits), lambda x: x[1] - x[0]):
        run = [b for _, b in run]
        taken = F.shiftrightunsigned(fp, run[0]).bitwiseAND(F.lit((1 << len(run)) - 1 if len(run) < 64 else -1))
        out, at = out.bitwiseOR(F.shiftleft(taken, at)), at + len(run)
    return out


def plan(fps: DataFrame, distance: int, most_parts: int = 4) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is used, for the least expected work."""
    n, both = bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    choices = {m: grouped_bits(n, both, m) for m in range(1, min(most_parts, distance + 1) + 1)}
    named = {f"p{m}_{i}": bits for m, groups in choices.items() for i, bits in enumerate(groups) if m > 1}
    # pairs that agree on a partition: counts of its values, squared and summed; one row for each partition reaches the driver
    filed = fps.select(F.posexplode(F.array(*(bits_of(F.col("fp"), bits) for bits in named.values())) if named else F.array().cast("array<bigint>")))
    same = {list(named)[r["pos"]]: float(r["pairs"]) for r in filed.groupBy("pos", "col").count().groupBy("pos").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")).alias("pairs")).collect()}
    best = (math.inf, [], [])
    for m, groups in sorted(choices.items(), reverse=True):  # of equal costs the more partitions, which need fewer probes
        costs = [expected(n, same.get(f"p{m}_{i}", 0.0), 2 * p[bits] * (1 - p[bits]), distance) for i, bits in enumerate(groups)]
        cost, thresholds = allocate(costs, distance - m + 1)
        if cost < best[0]:
            best = (cost, groups, thresholds)
    return [(bits, t) for bits, t in zip(best[1], best[2], strict=True) if t >= 0]


def links(fps: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of different fingerprints, a < b, that are linked directly or through others that are: fps's classes under
    "distance bits or fewer apart" are just the components of these pairs. fps: distinct, in column ``fp``, staged."""
    if not 0 <= distance <= 2:
        raise ValueError("distances over 2 would need points of a larger radius")
    fp = F.col("fp")
    used = plan(fps, distance)
    flips = [[sum(1 << x for x in places) for k in range(t + 1) for places in itertools.combinations(range(len(bits)), k)] for bits, t in used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches):
            own = b.column("fp").to_numpy().view(np.uint64)
            for part, (bits, _) in enumerate(used):
                value = np.zeros(len(own), np.uint64)
                for at, bit in enumerate(bits):
                    value |= ((own >> np.uint64(bit)) & np.uint64(1)) << np.uint64(at)
                for flip in flips[part]:
                    yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(np.full(len(own), part, np.int32)), pa.array((value ^ np.uint64(flip)).view(np.int64)), pa.array(np.full(len(own), flip == 0))], names=["fp", "part", "value", "own"])

    rows = fps.select("fp").mapInArrow(run, "fp long, part int, value long, own boolean")
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("any_own and n > 1")
    sizes = staged(sizes)
    cold = rows.join(sizes.where(F.col("n") <= bucket), ["part", "value"], "left_semi")
    x, y = cold.select("part", "value", F.col("fp").alias("a"), F.col("own").alias("own_a")), cold.select("part", "value", F.col("fp").alias("b"), F.col("own").alias("own_b"))
    pairs = x.join(y, (x["part"] == y["part"]) & (x["value"] == y["value"]) & (F.col("a") < F.col("b")) & (F.col("own_a") | F.col("own_b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    hot = rows.join(sizes.where(F.col("n") > bucket), ["part", "value"], "left_semi").select("fp").distinct()
    points = F.array(fp, *(fp.bitwiseXOR(F.lit(signed(1 << k))) for k in range(BITS)))
    meet = hot.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = meet.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    if distance < 2:  # points in common may be two bits apart
        stars = meet.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return pairs.unionByName(stars).distinct()


#: A value is a hub if it has more than one in so many of all rows, and more than so many, which one task takes easily; so there are
#: fewer than 1,000 hubs.
HUB_SHARE, HUB_ROWS = 1000, 100_000
#: Pairs of a graph that one task takes at least, so that small graphs don't cost many tasks a round.
TASK_ROWS = 500_000


def with_least(rows: DataFrame, key: str, value: str, total: int) -> tuple[DataFrame, list[str]]:
    """rows with ``low``, the least value of the row's key, and paths of tables that may be deleted when the result is written.
    total: how many rows there are at most.

    Counts and minima are pre-aggregated. The minima of hubs are sent out, a thousand at most; their rows stay where they are. The
    others meet theirs in a join.
    """
    lows = rows.groupBy(key).agg(F.min(value).alias("low"), F.count("*").alias("times"))
    if total <= HUB_ROWS:  # no key can be a hub
        return rows.join(lows.select(key, "low"), key), []
    lows, path = written(lows.coalesce(1 + total // TASK_ROWS))
    hub = F.col("times") > max(HUB_ROWS, total // HUB_SHARE)
    hubs = F.broadcast(lows.where(hub).select(key, "low"))
    return rows.join(hubs, key).unionByName(rows.join(hubs, key, "left_anti").join(lows.where(~hub).select(key, "low"), key)), [path]


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the pairs reaches. Alternates large stars (each node's larger neighbours join
    its smallest one) and small stars (its smaller ones do), which takes a number of rounds that grows as the logarithm of a chain's
    length; each round's pairs are written to the shared folder, the round's before are deleted, and only counts and sums reach the
    driver."""
    spark = pairs.sparkSession
    now, path = written(pairs.select("a", "b"))
    before = None
    while True:
        said = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if tuple(said) == before:
            return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = tuple(said)
        both = now.union(now.select("b", "a"))
        near, lows = with_least(both, "a", "b", 2 * said[0])
        large, stars = written(near.where("b > a").select(F.least("low", "a").alias("low"), "b").select(F.col("low").alias("a"), "b").distinct().coalesce(1 + said[0] // TASK_ROWS))
        deleted(spark, path, *lows)
        down, lows = with_least(large.select(F.col("b").alias("node"), F.col("a").alias("smaller")), "node", "smaller", said[0])
        now, path = written(down.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("smaller").alias("b")), F.struct(F.col("low").alias("a"), F.col("node").alias("b")))).alias("p")).select("p.*").where("a <> b").distinct().coalesce(1 + 2 * said[0] // TASK_ROWS))
        deleted(spark, stars, *lows)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, shingle: int = 3, extra: tuple[str, ...] = ()) -> DataFrame:
    """id, fp, root (the smallest fingerprint of its class), component (the smallest id that is reachable over links, its own
    included) and extra's columns of each row.

    Null and blank texts have fingerprint 0 and link as any other. Null ids count as larger than all others; a class of null ids only has
    a null component. Repeated rows stay. No row: no row.
    """
    prints = staged(fingerprints(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *extra), "text", ["id", *extra], shingle))
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes.select("fp"), distance))
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    several = joined.join(joined.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "root", "component")
    return prints.join(several, "fp").select("id", "fp", "root", "component", *extra)


# ---- near duplicates by similarity -------------------------------------------------------------------------------------------

#: Shingles' words and the Jaccard similarity from which texts are near duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Texts of which the most frequent shingles are learned, how often one must be met there to count as such, and how many at most do.
SAMPLE, MET, FREQUENT = 8192, 3, 1 << 17
#: Shingles whose hashes are lower than that are counted over all texts. A share of 0.3 of a text's shingles, if few of them are
#: frequent, nearly always holds a prefix, which is a fifth of them.
LOW = 3 * (1 << 64) // 10
#: Texts with one shingle in their prefixes that are compared pair by pair at once.
FEW = 16
#: Texts of a block that are compared with all others of it at once.
ROWS = 128
#: Bits of the map of texts that are candidates; its size doesn't depend on the input.
MAP_BITS = 26
_ODDS = 1e-9


def sequence_hash(words: list[bytes]) -> int:
    """Of the lower-cased (A-Z) words in a row: texts that differ in white space and such case alone are one text."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 7)).view(np.int64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_keys(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles; of all its words, if they are fewer."""
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = max(1, len(each) - size + 1)
    key = np.full(k, min(len(each), size), np.uint64)
    for at in range(min(len(each), size)):
        key = mixed(key, each[at : at + k])
    return np.unique(key)


def prefix_length(n: str, share: float) -> F.Column:
    """Of sets of n, how many of their first items must hold one that they share if share * n or more are shared."""
    return F.col(n) - F.ceil(share * F.col(n) - _ODDS) + 1


def sketch(keys: np.ndarray) -> np.ndarray:
    """One bit for each residue of the keys: whether an odd number has it; about as many bits as keys, a power of two. An item that
    only one of two sets has
    changes one bit, so sketches differ in no more bits than sets in items. Of a sketch twice as long, the halves' exclusive or is
    the shorter one."""
    bits = 1 << max(6, min(16, (len(keys) - 1).bit_length()))
    odd = np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def frequent_keys(docs: DataFrame, text: str, rate: int) -> np.ndarray:
    """The most frequent shingles of one text in so many, sorted. At most ``FREQUENT`` reach the driver."""
    t = F.coalesce(F.col(text), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in modest(batches):
            found = []
            for x in b.column(0):
                words = words_of(x.as_py())
                if (th := sequence_hash(words)) not in seen:
                    seen.add(th)
                    own = shingle_keys(words)
                    found.append((np.full(len(own), th), own))
            if found:
                th, own = map(np.concatenate, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(th)], names=["key", "th"])

    some = docs.select(t.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(rate)) == 0)
    common = some.mapInArrow(run, "key long, th long").distinct().groupBy("key").count().where(F.col("count") >= MET)
    top = [r["key"] for r in common.orderBy(F.desc("count"), "key").limit(FREQUENT).collect()]
    return np.sort(np.array(top, np.int64).view(np.uint64))


def texts_of(rows: DataFrame, text: str, frequent: np.ndarray) -> DataFrame:
    """rows without the text, and of it: ``th``, ``fp``, ``n`` (different shingles), ``sketch`` and ``low`` (the keys lower than
    ``LOW``, sorted, without frequent). A task gives a text's keys and sketch once, for later copies null."""
    names = [c for c in rows.columns if c != text]
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in modest(batches):
            cells = []
            for x in b.column(at):
                t = x.as_py()
                words = words_of(t)
                th, fp = sequence_hash(words), signed(fingerprint(t))
                if th in seen:
                    cells.append((th, fp, None, None, None))
                    continue
                seen.add(th)
                own = shingle_keys(words)
                low = own[: np.searchsorted(own, np.uint64(LOW))]
                if len(frequent):
                    low = low[frequent[np.minimum(np.searchsorted(frequent, low), len(frequent) - 1)] != low]
                cells.append((th, fp, len(own), sketch(own), low.view(np.int64)))
            if cells:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                arrays = [pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + arrays, names=[*names, "th", "fp", "n", "sketch", "low"])

    added = "th long, fp long, n int, sketch array<long>, low array<long>"
    return rows.mapInArrow(run, StructType([*rows.select(*names).schema.fields, *StructType.fromDDL(added).fields]))


def fit(n: str, m: str, similarity: float) -> F.Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - _ODDS


def close(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than sets of such similarity can differ in items, and ``bits``."""
    of = lambda x: nodes.select(F.col("th").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")

    def cut(x: F.Column, size: F.Column) -> F.Column:
        halves = F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) == size, x).otherwise(halves)

    size = F.least(F.size("sa"), F.size("sb"))
    bits = F.aggregate(F.zip_with(cut(F.col("sa"), size), cut(F.col("sb"), size), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    return both.where(fit("na", "nb", similarity)).withColumn("bits", bits).where(F.col("bits") <= (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + _ODDS).select("a", "b", "bits")


def shingles(ids: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(th, s) of the texts with such ids (column ``th``), and of few others: the keys of all their shingles. A bit map of a fixed
    size tells a pass over the documents which
    texts they may be, so that, while these are fewer than its bits, only their shingles are shuffled; at worst all texts' are."""
    at = ids.select((F.col("th").bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1).alias("p"))  # the functions count from 1
    rows = at.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    parts = {r["k"]: bytes(r["m"]) for r in rows}  # at most 2 ** MAP_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in modest(batches):
            out: dict[int, np.ndarray] = {}
            for t in b.column(0):
                words = words_of(t.as_py())
                th = sequence_hash(words)
                p = th & ((1 << MAP_BITS) - 1)
                m, at = parts.get(p // 32768 + 1), p % 32768
                if m is not None and m[at // 8] >> at % 8 & 1 and th not in seen:
                    seen.add(th)
                    out[th] = shingle_keys(words).view(np.int64)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.list_(pa.int64()))], names=["th", "s"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "th long, s array<long>").groupBy("th").agg(F.first("s").alias("s"))


def verified(pairs: DataFrame, docs: DataFrame, text: str, similarity: float) -> DataFrame:
    """The pairs of texts whose shingles' Jaccard similarity is at least that."""
    sets = shingles(pairs.select(F.explode(F.array("a", "b")).alias("th")), docs, text)
    both = pairs.select("a", "b").join(sets.select(F.col("th").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("th").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared) - _ODDS).select("a", "b")


class Block:
    """Texts that are compared with one another: sizes, components, whether the shingle that they share suffices for partners that
    aren't smaller, sketches."""

    def __init__(self, t: pa.Table, similarity: float):
        self.similarity = similarity
        self.th, self.n, self.root = (t[c].to_numpy() for c in ("th", "n", "root"))
        self.near = t["near"].to_numpy(zero_copy_only=False)
        self.sketches = [np.asarray(x, np.int64).view(np.uint64) for x in t["sketch"].to_pylist()]  # bits of a signed number would be counted of its absolute value

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of the pairs of different components that sizes and sketches allow, closest first within each run of up to ``ROWS`` texts i."""
        longs = np.array([len(x) for x in self.sketches])
        n, near = self.n.astype(np.float64), self.near
        share = (1 - self.similarity) / (1 + self.similarity)
        for size in np.unique(longs).tolist():
            own = np.flatnonzero(longs == size)
            other = np.flatnonzero((longs == size) | (longs == 2 * size))
            sketches = np.stack([self.sketches[k] if longs[k] == size else self.sketches[k][:size] ^ self.sketches[k][size:] for k in other])
            mine = np.stack([self.sketches[k] for k in own])
            for at in range(0, len(own), ROWS):
                i, a = own[at : at + ROWS], mine[at : at + ROWS]
                bits = np.zeros((len(i), len(other)), np.int32)
                for c in range(size):
                    bits += np.bitwise_count(a[:, c, None] ^ sketches[None, :, c])
                ni, nj = n[i][:, None], n[other][None, :]
                ok = (bits <= (ni + nj) * share + _ODDS) & (np.minimum(ni, nj) >= self.similarity * np.maximum(ni, nj) - _ODDS) & (self.root[i][:, None] != self.root[other][None, :])
                ok &= np.where(ni < nj, near[i][:, None], np.where(ni > nj, near[other][None, :], near[i][:, None] & near[other][None, :]))
                ok &= (longs[other] > size)[None, :] | (i[:, None] < other[None, :])  # of one length, each pair once
                x, y = np.nonzero(ok)
                by = np.argsort(bits[x, y], kind="stable")
                yield i[x[by]], other[y[by]]


def blocks(rows: DataFrame, times: str, size: int) -> DataFrame:
    """rows of a key in chunks of about ``size``, and each chunk once for each chunk of its key: two texts of a key meet in the
    block of their two chunks."""
    chunks = F.ceil(F.col(times) / size)
    rows = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("th"), "chunks"))
    return rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumns({"i": F.least("chunk", "with"), "j": F.greatest("chunk", "with")}).drop("chunks", "chunk", "with")


def apart_links(filed: DataFrame, classes: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, similarity: float) -> DataFrame:
    """Pairs (a, b) that have the components which all pairs of such similarity have among texts with one key but of different
    components so far.

    The texts of a key are compared in blocks of bounded size, within tasks. First by sketches: a pair counts in the block of the
    smallest key that suffices
    for it, and what comes out are the texts that have any partner. Only these bring their shingles, for second blocks, which verify
    pairs closest first,
    but none of texts that the block has linked by then: what comes out is a forest, fewer links than texts.
    """
    bucket = Window.partitionBy("key")
    apart = filed.join(classes, F.col("th") == F.col("node"), "left").select("key", "th", "n", "near", F.coalesce("root", "th").alias("root"))
    apart = staged(apart.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket), "times": F.count("*").over(bucket)}).where("low <> high").drop("low", "high"))
    each = apart.groupBy("th").agg(F.collect_list("key").alias("own"), F.collect_list(F.when(F.col("near"), F.col("key"))).alias("own_near"))  # at most a text's prefix
    rows = apart.join(each, "th").join(nodes.select("th", "sketch"), "th")

    def first(t: pa.Table) -> pa.Table:
        block, key = Block(t, similarity), t["key"][0].as_py()
        own, near = ([frozenset(x) for x in t[c].to_pylist()] for c in ("own", "own_near"))
        active = np.zeros(t.num_rows, bool)
        for i, j in block.candidates():
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if active[a] and active[b]:
                    continue
                small, large = (a, b) if block.n[a] <= block.n[b] else (b, a)
                if min(near[small] & (near if block.n[a] == block.n[b] else own)[large]) == key:
                    active[a] = active[b] = True
        return pa.table({"key": pa.array(np.full(int(active.sum()), key)), "th": pa.array(block.th[active])})

    active = staged(blocks(rows, "times", 1024).groupBy("key", "i", "j").applyInArrow(first, "key long, th long").distinct())
    if active.isEmpty():
        return active.select(F.col("key").alias("a"), F.col("th").alias("b"))
    rows = apart.drop("times").join(active, ["key", "th"]).withColumn("times", F.count("*").over(bucket)).join(nodes.select("th", "sketch"), "th").join(shingles(active.select("th"), docs, text), "th")

    def second(t: pa.Table) -> pa.Table:
        block = Block(t, similarity)
        sets = [np.asarray(x, np.int64) for x in t["s"].to_pylist()]
        group = np.unique(block.root, return_inverse=True)[1].tolist()
        parent = list(range(max(group, default=-1) + 1))
        links = []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in block.candidates():
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                x, y = find(group[a]), find(group[b])
                if x != y:
                    shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) - _ODDS:
                        parent[x] = y
                        links.append((min(block.th[a], block.th[b]), max(block.th[a], block.th[b])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return staged(blocks(rows, "times", 256).groupBy("key", "i", "j").applyInArrow(second, "a long, b long").distinct())


def prefixes(prints: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(key, th, n, near) of the shingles in texts' prefixes that other texts have in theirs, and whether they suffice for partners that
    aren't smaller: those of at most ``FEW`` texts, and those of more.

    The order of all shingles: first the low ones that at most ``FEW`` texts hold, counted over all texts, by key. A text that has too
    few of these for its prefix brings all its other shingles, and these come by the number of such texts that hold them. So a
    shingle with many texts is in the prefix only of a text that lacks others, however many texts there are.
    """
    bucket = Window.partitionBy("key")
    prefix, short = prefix_length("n", similarity), prefix_length("n", 2 * similarity / (1 + similarity))
    sets = prints.where("low is not null")
    low = sets.select("th", "n", F.posexplode("low").alias("at", "key"))
    low = low.withColumns({"least": F.min("th").over(bucket), "most": F.max("th").over(bucket)}).where("least <> most").select("key", "th", "n", "at").distinct()
    low = staged(low.withColumn("times", F.count("*").over(bucket)))
    gone = staged(low.where(F.col("times") > FEW).groupBy("th").agg(F.collect_list("at").alias("gone"), F.collect_list("key").alias("crowded")))  # at most a text's own
    few = low.where(F.col("times") <= FEW).join(gone, "th", "left").withColumn("at", F.col("at") - F.when(F.col("gone").isNull(), 0).otherwise(F.size(F.filter("gone", lambda x: x < F.col("at")))))
    few = staged(few.where(F.col("at") < prefix).select("key", "th", "n", (F.col("at") < short).alias("near")))

    lacking = nodes.select("th", "n", "lows").join(gone, "th", "left").withColumn("have", F.col("lows") - F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")))
    lacking = staged(lacking.where(F.col("have") < prefix).select("th", "n", "have", F.coalesce("crowded", F.array().cast("array<long>")).alias("crowded")))
    own = sets.select("th", "low").join(lacking.select("th"), "th", "left_semi").groupBy("th").agg(F.first("low").alias("low"))
    rest = lacking.join(own, "th").join(shingles(lacking.select("th"), docs, text), "th")
    rest = staged(rest.select("th", "n", "have", F.explode(F.array_except("s", F.array_except("low", "crowded"))).alias("key")))
    rest = rest.join(rest.groupBy("key").agg(F.count("*").alias("times")), "key")
    rest = rest.withColumn("at", F.col("have") + F.row_number().over(Window.partitionBy("th").orderBy("times", "key")) - 1).where((F.col("at") < prefix) & (F.col("times") > 1))
    rest = staged(rest.select("key", "th", "n", (F.col("at") < short).alias("near"), F.count("*").over(bucket).alias("times")))
    return few.unionByName(rest.where(F.col("times").between(2, FEW)).drop("times")), rest.where(F.col("times") > FEW).drop("times")


def alike(prints: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, linked: DataFrame, similarity: float) -> DataFrame:
    """(node, root): the components of texts under linked's pairs and "the Jaccard similarity of the shingles is at least that".
    prints: as of ``texts_of``;
    nodes: one row for each different text; both staged.

    Two sets that similar have a shingle in common among the first n - ceil(similarity * n) + 1 of each, in any one order of all
    shingles, and among fewer
    of the smaller one. The order is by frequency, so that what many texts share comes last (``prefixes``); it bears on the work, not
    on the result.
    Texts that share such a shingle are filed together. Few are compared pair by pair; of more, each is compared with the next
    smaller and with the first at
    once, and with the others in blocks, only if they aren't in one component by then (``apart_links``). Comparing is by sketches,
    whose bits bound
    the difference from below; what passes is verified by the shingles themselves: for each text the closest first, then what would
    still join components.
    """
    bucket = Window.partitionBy("key")
    few, many = prefixes(prints, nodes, docs, text, similarity)
    smaller = F.when(F.col("n") < F.col("m"), F.col("near")).when(F.col("n") > F.col("m"), F.col("near_b")).otherwise(F.col("near") & F.col("near_b"))
    one = few.withColumnRenamed("th", "a").join(few.withColumnsRenamed({"th": "b", "n": "m", "near": "near_b"}), "key").where((F.col("a") < F.col("b")) & fit("n", "m", similarity) & smaller).select("a", "b")
    some = many
    for name, w in (("before", bucket.orderBy("n", "th")), ("first", bucket.orderBy("th"))):
        some = some.withColumn(name, (F.lag if name == "before" else F.first)(F.struct("th", "n")).over(w))
    some = some.select("th", "n", F.explode(F.array("before", "first")).alias("o")).select("th", "n", F.col("o.th").alias("other"), F.col("o.n").alias("m"))
    some = some.where((F.col("th") != F.col("other")) & fit("n", "m", similarity)).select(F.least("th", "other").alias("a"), F.greatest("th", "other").alias("b"))
    tried = staged(close(one.unionByName(some).distinct(), nodes, similarity))
    best = staged(tried.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")).select("a", "b"))
    found = staged(verified(best, docs, text, similarity))
    classes = staged(components(linked.unionByName(found)))
    roots = lambda x: classes.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    left = tried.select("a", "b").join(best, ["a", "b"], "left_anti").join(roots("a"), "a", "left").join(roots("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    left = staged(left)
    more = staged(verified(left, docs, text, similarity)) if not left.isEmpty() else left
    more = more.unionByName(apart_links(many, classes, nodes, docs, text, similarity))
    return classes if more.isEmpty() else components(linked.unionByName(found).unionByName(more))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near duplicates, that with the smallest id (null ids last; of several the one with the
    smallest hash of all its
    columns; of equal rows one). All columns as they were, whatever their names. No row: no row. Map-typed columns aren't supported.

    Texts are linked if their fingerprints differ in ``distance`` bits or fewer, which loses no link, or if ``similarity`` or more
    of their shingles of five
    words are the same, which loses none either (see ``alike``). Null and blank texts are one text.
    """
    rows = docs.select(packed(docs), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumns({"h": F.xxhash64("row"), "h2": F.xxhash64(F.lit(1), "row")})
    frequent = frequent_keys(docs, text, max(1, docs.count() // SAMPLE))
    prints = staged(texts_of(rows.select("h", "h2", "id", "text"), "text", frequent))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "h2")).alias("first")
    nodes = staged(prints.groupBy("th").agg(F.first("fp").alias("fp"), first, F.max("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.max(F.size("low")).alias("lows")))
    heads = staged(nodes.groupBy("fp").agg(F.min("th").alias("head")))
    copies = nodes.select("fp", "th").join(heads, "fp").where("head <> th").select(F.col("head").alias("a"), F.col("th").alias("b"))
    joined = links(heads.select("fp"), distance)
    for x in ("a", "b"):
        joined = joined.join(heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")), x)
    near = staged(copies.unionByName(joined.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))))
    classes = alike(prints, nodes, docs, text, near, similarity)
    chosen = nodes.select("th", "first").join(classes, F.col("th") == F.col("node"), "left").groupBy(F.coalesce("root", "th").alias("class")).agg(F.min("first").alias("first")).select("first.h", "first.h2")
    return rows.select("h", "h2", "row").dropDuplicates(["h", "h2"]).join(chosen, ["h", "h2"], "left_semi").select(*unpacked(docs.columns))
