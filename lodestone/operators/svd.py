"""Truncated singular value decomposition of a sparse matrix by random projection, worked on the row side, and texts folded into its space.

The matrix is a table of cells (row, feature, value). A block of l directions is a table of rows with l columns, never an array on
the driver; X transposed times it, and X times that, are each a join and an aggregation of
l sums, added up before they are shuffled. The block is made orthonormal by a tall-skinny QR: each task reduces its rows to one l x
l triangle, triangles are reduced in groups, the last few on the driver, and the rows are
multiplied by the triangle's inverse; twice, as once leaves rounding behind. The Gaussian start comes from a hash of the row, so it
doesn't depend on the partitioning. Only l x l matrices reach the driver, whatever the number of rows and features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.staging import staged

#: Rows of a block that a task reduces at a time.
ROWS = 8192


@dataclass
class Latent:
    """rows: row, vector (unit length, or zeros); features: feature, vector (right singular vectors); singular values; the share of
    the matrix's squares that they hold."""

    rows: DataFrame
    features: DataFrame
    singular: np.ndarray
    captured: float


def names(l: int) -> list[str]:
    return [f"q{k}" for k in range(l)]


def gaussian(row: Column, k: int, seed: int) -> Column:
    """A standard normal number from a hash."""

    def uniform(part: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(row, F.lit(k), F.lit(seed), F.lit(part)), 11).cast("double") + 0.5) / float(1 << 53)

    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))


def times(cells: DataFrame, block: DataFrame, by: str, to: str, l: int) -> DataFrame:
    """For each ``to`` the sum of value times the block's row of ``by``."""
    return cells.join(block, by).groupBy(to).agg(*(F.sum(F.col("value") * F.col(q)).alias(q) for q in names(l)))


def matrix_of(batch: pa.RecordBatch, l: int) -> np.ndarray:
    return np.column_stack([batch.column(q).to_numpy(zero_copy_only=False) for q in names(l)]) if l else np.zeros((batch.num_rows, 0))


def reduced(block: DataFrame, l: int, start, step) -> np.ndarray | None:
    """An l x l matrix of each task, by ``step`` over slices of its rows, brought together by ``step`` again: within groups of
    tasks, then on the driver."""
    tasks = block.rdd.getNumPartitions()
    group = max(1, math.isqrt(tasks))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                held = step(held, start(matrix_of(b.slice(at, ROWS), l)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([held.tobytes()], pa.binary())], names=["task", "body"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for task, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[task // group] = step(held.get(task // group), np.frombuffer(body).reshape(-1, l))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["task", "body"])

    kind = "task long, body binary"
    parts = block.select(*names(l)).mapInArrow(part, kind)
    if group > 1:
        parts = parts.repartition(group, F.floor(F.col("task") / group)).sortWithinPartitions("task").mapInArrow(together, kind)
    out = None
    for r in sorted(parts.collect(), key=lambda r: r["task"]):
        out = step(out, np.frombuffer(r["body"]).reshape(-1, l))
    return out


def triangle(held: np.ndarray | None, more: np.ndarray) -> np.ndarray:
    return np.linalg.qr(more if held is None else np.concatenate([held, more]), mode="r")


def turned(block: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """The block's rows times a small matrix."""
    l, to = by.shape
    kind = block.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix_of(b, l) @ by
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(x[:, k]) for k in range(to))], names=[key, *names(to)])

    return block.select(key, *names(l)).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{q} double" for q in names(to))]))


def orthonormal(block: DataFrame, key: str, l: int) -> DataFrame:
    """A block of the same column space with orthonormal columns. Directions that the others already span become zeros."""
    for _ in range(2):
        r = reduced(block, l, lambda x: x, triangle)
        if r is None:
            return block
        u, s, vt = np.linalg.svd(r)
        s, vt = s[:l], vt
        good = s > (s[0] if len(s) else 0) * 1e-13
        inverse = np.zeros((l, l))
        inverse[:, : len(s)][:, good] = vt[: len(s)].T[:, good] / s[good]
        block = staged(turned(block, key, inverse))
    return block


def latent(cells: DataFrame, dims: int, row: str = "row", feature: str = "feature", value: str = "value", oversample: int = 10, iterations: int = 4, seed: int = 7) -> Latent:
    """[G13] The ``dims`` leading singular vectors of the matrix of cells; cells of one place add up, null and zero values are no cells.

    Vectors of rows are U * S of unit length; rows whose projection is zero have zeros. Signs: a singular vector's largest entry
    over features is positive. dims is the number of distinct directions at most.
    """
    x = cells.where(F.coalesce(F.col(value).cast("double"), F.lit(0.0)) != 0).groupBy(F.col(row).alias("row"), F.col(feature).alias("feature")).agg(F.sum(F.col(value).cast("double")).alias("value"))
    x = staged(x)
    squares, rows_n, features_n = x.agg(F.sum(F.col("value") * F.col("value")), F.countDistinct("row"), F.countDistinct("feature")).first()
    l = max(1, min(dims + oversample, rows_n or 1, features_n or 1))
    q = x.select("row").distinct().select("row", *(gaussian(F.col("row"), k, seed).alias(n) for k, n in enumerate(names(l))))
    for _ in range(iterations + 1):
        y = staged(times(x, q, "row", "feature", l))
        q = orthonormal(staged(times(x, y, "feature", "row", l)), "row", l)
    b = staged(times(x, q, "row", "feature", l))
    gram = reduced(b, l, lambda m: m.T @ m, lambda held, more: more if held is None else held + more)
    gram = np.zeros((l, l)) if gram is None else gram
    s2, u = np.linalg.eigh((gram + gram.T) / 2)
    by = np.argsort(-s2)[:dims]
    s2, u = s2[by], u[:, by]
    good = s2 > (s2[0] if len(s2) else 0) * 1e-13
    s, u = np.sqrt(s2[good]), u[:, good]
    k = len(s)
    right = turned(b, "feature", u / s if k else u)
    ends = right.agg(*(F.max_by(n, F.struct(F.abs(n), "feature")).alias(n) for n in names(k))).first() if k else []
    sign = np.array([-1.0 if (v or 0) < 0 else 1.0 for v in ends])
    right = turned(b, "feature", u / s * sign) if k else b
    left = turned(q, "row", u * s * sign) if k else q
    vector = F.array(*names(k)).cast("array<double>")
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in names(k)), F.lit(0.0)))
    unit = F.when(norm > 0, F.transform(vector, lambda v: v / norm)).otherwise(vector)
    return Latent(left.select("row", unit.alias("vector")), right.select("feature", vector.alias("vector")), s, float((s * s).sum() / squares) if squares else 0.0)


def folded(tokens: DataFrame, vocabulary: DataFrame, dims: int, doc: str = "doc_id", word: str = "word", vector: str = "vector") -> DataFrame:
    """[G13] doc and vector (unit length) of texts in the space of a vocabulary's vectors: the sum of (1 + ln count) times the
    word's vector. tokens: one row an occurrence; words beyond the vocabulary
    don't count. A text without any known word has zeros. Occurrences are counted before they meet the vectors."""
    n = tokens.groupBy(F.col(doc).alias("doc"), F.col(word).alias("word")).agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    known = vocabulary.select(F.col(word).alias("word"), *(F.get(vector, F.lit(k)).cast("double").alias(q) for k, q in enumerate(names(dims))))
    sums = n.join(known, "word", "left").groupBy("doc").agg(*(F.coalesce(F.sum(F.col("tf") * F.col(q)), F.lit(0.0)).alias(q) for q in names(dims)))
    norm = F.sqrt(sum((F.col(q) * F.col(q) for q in names(dims)), F.lit(0.0)))
    return sums.select(F.col("doc").alias(doc), F.transform(F.array(*names(dims)), lambda v: F.when(norm > 0, v / norm).otherwise(0.0)).alias("vector"))
