"""Whitening of vectors by their leading principal components, which a matrix-free block subspace iteration finds.

The covariance is never formed. Each step is one pass of Spark over the rows: a task centres its rows exactly, in integers, and adds
up its part of Xt(XQ) for a block Q of directions;
the parts, of dims x block numbers each, are added in two levels by the number of the task, so that the driver gets the root of the
tasks' number and the order of adding is the same in each run. There, QR keeps the basis
orthonormal and Rayleigh-Ritz gives the best pairs within it; the next pass's block are the directions of their residuals. Passes go
on until the residual of each of the k
pairs, in a pass over the data of its own, certifies it.

Entries are made integers, ``floor(scale * c) + offset``; sums of integers are exact, and a row's distance from the mean is ``(n * x
- S) / n`` with the numerator exact, so a large common offset costs no digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import modest
from lodestone.llm.topk import usable

SCALE, OFFSET = 64, 1_000_000
#: Directions of a block beyond twice the components asked for make passes fewer, and each a little dearer.
BLOCK = 2
#: Blocks that Rayleigh-Ritz works on; beyond, the best pairs start a new basis.
DEPTH = 4
#: A pair is certified when its residual is this small against the largest eigenvalue.
CERTAIN = 1e-12
PASSES = 200


@dataclass(frozen=True)
class Whitening:
    """n rows with sums S and total variance; the components as columns, with their variances, falling; the residuals that certify
    them; the largest error of the whitened rows' covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int


def integers(lists: pa.Array, dims: int, scale: int, offset: int) -> np.ndarray:
    """Rows of floor(scale * c) + offset."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dims)
    return np.floor(scale * values).astype(np.int64) + offset


def added(rows: DataFrame, body: Callable[[Iterator[pa.RecordBatch]], np.ndarray], tasks: int) -> list[np.ndarray]:
    """body's array of each task, added up by groups of neighbouring tasks in their order: one array a group."""
    group = max(1, math.isqrt(tasks))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = body(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([found.tobytes()], pa.binary())], names=["task", "body"])

    kind = body.kind  # type: ignore[attr-defined]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:  # sorted by task
            for task, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, kind)
                held[task // group] = held[task // group] + x if task // group in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["task", "body"])

    parts = rows.mapInArrow(part, "task long, body binary")
    if group > 1:
        parts = parts.repartition(min(group, 64), F.floor(F.col("task") / group)).sortWithinPartitions("task").mapInArrow(total, "task long, body binary")
    return [np.frombuffer(r["body"], kind) for r in sorted(parts.collect(), key=lambda r: r["task"])]


def sums_of(dims: int, scale: int, offset: int):
    """n, then the sums of x - offset and of its squares."""

    def body(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        n, s, q = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in modest(batches, 8192):
            x = integers(b.column("v"), dims, scale, 0)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        return np.concatenate([[n], s, q]).astype(np.int64) if n else None

    body.kind = np.int64
    return body


def product_of(n: int, sums: np.ndarray, q: np.ndarray, scale: int, offset: int):
    """Xt(XQ) / n of centred rows."""
    dims = len(sums)

    def body(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out, any_row = np.zeros((dims, q.shape[1])), False
        for b in modest(batches, 8192):
            x = centred(integers(b.column("v"), dims, scale, offset), n, sums)
            out += x.T @ (x @ q)
            any_row = any_row or len(x) > 0
        return (out / n).reshape(-1) if any_row else None

    body.kind = np.float64
    return body


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def fit(vectors: DataFrame, dims: int, k: int, scale: int = SCALE, offset: int = OFFSET, block: int | None = None, certain: float = CERTAIN, passes: int = PASSES, seed: int = 7) -> Whitening | None:
    """vectors: one column ``v``, arrays of ``dims`` finite numbers. None where there is no row.

    Components of no variance (to rounding) can't be whitened and are left out; k is dims at most. Raises where ``passes`` don't
    certify all.
    """
    tasks = vectors.rdd.getNumPartitions()
    parts = added(vectors, sums_of(dims, scale, offset), tasks)
    if not parts:
        return None
    moments = [sum(int(p[j]) for p in parts) for j in range(2 * dims + 1)]
    n, shifted, squares = moments[0], moments[1 : dims + 1], moments[dims + 1 :]
    # x = y + offset with y's exact sums: n * n * variance = n * sum(y * y) - sum(y) ** 2, in Python's integers
    spread = sum(n * q - s * s for q, s in zip(squares, shifted, strict=True))
    trace = spread / (n * n)
    sums = np.array([s + n * offset for s in shifted], np.int64)
    k = min(k, dims)
    width = min(dims, block or BLOCK * k)

    def times(q: np.ndarray) -> np.ndarray:
        found = added(vectors, product_of(n, sums, q, scale, offset), tasks)
        return np.sum(np.stack(found), axis=0).reshape(q.shape)

    if spread == 0:
        return Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), trace, np.zeros(0), 0.0, 0)
    basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    for step in range(1, passes + 1):
        basis, images = np.concatenate([basis, new], axis=1), np.concatenate([images, times(new)], axis=1)
        small = basis.T @ images
        e, u = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-e, kind="stable")[: max(width, k)]
        e, u = e[best], u[:, best]
        ritz, image = basis @ u, images @ u
        floor = dims * np.finfo(float).eps * max(e[0], 0)
        live = min(k, int((e > floor * 4).sum()))
        residual = image - ritz * e
        sizes = np.linalg.norm(residual, axis=0)
        if live == 0 or sizes[:live].max() <= certain * e[0]:
            made = certified(ritz[:, :live], times, trace, n, sums, step + 1)
            if made.residuals.max(initial=0.0) <= certain * 4 * e[0]:
                return made
            basis, images, new = np.zeros((dims, 0)), np.zeros((dims, 0)), np.linalg.qr(ritz)[0]
            continue
        if basis.shape[1] + width > min(dims, DEPTH * width):
            basis, images = ritz, image  # the best pairs begin a new basis
        new = residual[:, sizes > floor]
        for _ in range(2):  # twice is enough
            new = new - basis @ (basis.T @ new)
            new = new[:, np.linalg.norm(new, axis=0) > floor]
            new = np.linalg.qr(new)[0] if new.shape[1] else new
        new = new[:, : max(0, dims - basis.shape[1])]
        if not new.shape[1]:
            basis, images, new = np.zeros((dims, 0)), np.zeros((dims, 0)), np.linalg.qr(ritz)[0]
    raise RuntimeError(f"{passes} passes did not certify {k} components; the largest residual is {sizes[:k].max() / e[0]:.1e} of the largest eigenvalue")


def certified(u: np.ndarray, times, trace: float, n: int, sums: np.ndarray, passes: int) -> Whitening:
    """The pairs' residuals, variances and the whitened rows' covariance by a pass of their own."""
    u = np.linalg.qr(u)[0]
    image = times(u)
    small = u.T @ image
    e, turn = np.linalg.eigh((small + small.T) / 2)
    e, turn = e[::-1], turn[:, ::-1]
    u, image = u @ turn, image @ turn
    sign = np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)  # the largest entry of each is positive
    u, image = u * sign, image * sign
    covariance = (u.T @ image) / np.sqrt(np.outer(e, e))
    error = float(np.abs(covariance - np.eye(len(e))).max(initial=0.0))
    return Whitening(n, sums, u, e, trace, np.linalg.norm(image - u * e, axis=0), error, passes)


def deviations(centred_n: np.ndarray) -> np.ndarray:
    """Sums of squares of whole numbers, exactly. Raises where one is beyond a long."""
    most = int(np.abs(centred_n).max(initial=0))
    if centred_n.shape[1] * most * most < 1 << 63:
        return (centred_n * centred_n).sum(1)
    exact = [sum(int(y) * int(y) for y in row) for row in centred_n]
    if max(exact) >= 1 << 63:
        raise OverflowError("a row's deviation is beyond a long")
    return np.array(exact, np.int64)


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 32, scale: int = SCALE, offset: int = OFFSET, block: int | None = None) -> DataFrame:
    """For each row and component (from 1, by falling variance): vec_id, component, n, deviation (sum of (n * x - S) ** 2 over
    dimensions), whitened, explained (share of the total variance),
    identity_error (largest absolute entry of the whitened rows' covariance minus the identity).

    Vectors that are null or hold null, NaN or infinite components take no part, nor do vectors whose length isn't the most frequent
    one (of equals, the longest) or is 0. Rows that repeat count as
    often as they occur, null ids stay. Directions without variance are no components, so equal rows alone give no row. Components
    of equal variance are any orthonormal ones. Entries whose sums of squares
    go beyond a long raise an error. Other columns are not read.
    """
    v = F.col(vector)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(usable(F.col("v")) & (F.size("v") > 0)).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    kind = vectors.select(F.col(vec_id).alias("vec_id")).schema[0].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    largest = F.max(F.array_max(F.transform("v", F.abs))).alias("largest")
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("count"), largest).orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, most = lengths["dims"], scale * lengths["largest"] + 1
    if lengths["count"] * max(most * most, most + abs(offset)) >= 1 << 62:
        raise ValueError("components are too large for exact sums")
    rows = rows.where(F.size("v") == dims)
    model = fit(rows.select("v"), dims, k, scale, offset, block)
    return rows.mapInArrow(projected(model, dims, scale, offset), schema)


def projected(model: Whitening, dims: int, scale: int, offset: int):
    found = model.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches, 1024):
            x = model.n * integers(b.column("v"), dims, scale, offset) - model.sums
            rows = len(x)
            out = (x / model.n) @ model.components / np.sqrt(model.variances)
            columns = [
                b.column("vec_id").take(pa.array(np.repeat(np.arange(rows), found))),
                pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * found, model.n)),
                pa.array(np.repeat(deviations(x), found)),
                pa.array(out.reshape(-1)),
                pa.array(np.tile(model.variances / model.trace if model.trace else model.variances, rows)),
                pa.array(np.full(rows * found, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
