"""Exact top-k by inner product, by a uniform threshold in three phases.

A score is the sum of local scores over groups of dimensions, a ranked list for each group. First, each task takes the best
entries of each list for each query, and resolves them, which gives it k scores that really occur; the largest k-th score of all tasks is
a safe cutoff, as at least k rows reach it. The cutoff is sent out. A row whose local scores all lie below a uniform share of the
cutoff can't reach it, so
second, each task collects the entries at or above that share from its lists. Third, it resolves what these lack, and keeps the rows
that reach the
cutoff, k of a task's at most. The k best of those are the answer.

Queries are taken in chunks of a bounded number, dealt evenly; a chunk's vectors and cutoffs go to all tasks, so what is sent out
doesn't grow. All
rows are read for each chunk and never moved: a task returns k rows a query at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import modest, staged

GROUPS = 4
CHUNK = 4096
#: Queries whose scores against a batch of rows are held at a time.
AT_ONCE = 256
NONE = -np.inf


def usable(v: Column) -> Column:
    """Not null and without null or non-finite components."""
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(v: Column, scale: int = 64) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of lists as doubles; missing components are 0."""
    n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False))
    out = np.zeros((len(lists), dims))
    out[np.arange(dims)[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def local_scores(queries: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    """(group, query, row)."""
    cuts = np.linspace(0, rows.shape[1], groups + 1).astype(int)
    return np.stack([queries[:, a:b] @ rows[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def blocks(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, groups: int):
    """(queries' slice, rows' ids, local scores with a query's own row out of all lists)."""
    for b in modest(batches, 2048):
        row_ids = b.column(0).to_numpy()
        rows = matrix(b.column(1), queries.shape[1])
        for at in range(0, len(ids), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            s = local_scores(queries[part], rows, groups)
            s[:, ids[part][:, None] == row_ids[None, :]] = NONE
            yield part, row_ids, s


def gather(ids: np.ndarray, queries: np.ndarray, groups: int, k: int):
    """First phase: each query's k-th best score among the resolved entries of this task's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), NONE)
        for part, _, s in blocks(batches, ids, queries, groups):
            n = s.shape[2]
            total = s.sum(0)
            if n > k * groups:
                own = np.sort(np.concatenate([np.argpartition(x, n - k, axis=1)[:, n - k :] for x in s], axis=1), axis=1)
                total = np.take_along_axis(total, own, 1)
                total[:, 1:][own[:, 1:] == own[:, :-1]] = NONE
            both = np.concatenate([best[part], total], axis=1)
            best[part] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        kth = best.min(1)
        has = np.flatnonzero(kth > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(kth[has])], names=["q", "kth"])

    return run


def resolve(ids: np.ndarray, queries: np.ndarray, cutoff: np.ndarray, groups: int, k: int):
    """Second and third phase: rows that reach the cutoff, of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for part, row_ids, s in blocks(batches, ids, queries, groups):
            least = cutoff[part][:, None]
            share = np.where(np.isfinite(least), least / groups, NONE)
            q, r = np.nonzero((s >= share).any(0))  # sufficient: some local score reaches the uniform share
            score = s[:, q, r].sum(0)
            keep = (score >= cutoff[part][q]) & (score > NONE)
            kept.append((q[keep] + part.start, row_ids[r[keep]], score[keep]))
            size += int(keep.sum())
            if size > 4 * k * len(ids):
                kept = [best(kept, k)]
                size = len(kept[0][0])
        if kept:
            q, row, score = best(kept, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(row), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def best(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k first by score, descending, then id."""
    q, row, score = (np.concatenate(x) for x in zip(*kept, strict=True))
    by = np.lexsort((row, -score, q))
    q, row, score = q[by], row[by], score[by]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else q
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[rank < k], row[rank < k], score[rank < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", groups: int = GROUPS, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows other than its own; ties go to the smaller id.

    Components become floor(64 * x). Null vectors, such with null or non-finite components and rows without id take no part. Missing
    components of a
    shorter vector are 0. A repeated row is a candidate as often as it occurs; an id is one query (of several vectors, the
    smallest), and no row of
    that id is its candidate. Scores must be below 2 ** 53. Fewer than k candidates: all.
    """
    spark = vectors.sparkSession
    v = F.col(vector)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", whole(F.col("v")).cast("array<double>").alias("v"), "is_query")
    dims, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if dims and most and dims * most * most >= 1 << 53:
        raise ValueError("components are too large for exact scores")
    asked = rows.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    n = asked.count()
    parts = max(1, math.ceil(n / chunk))
    asked = staged(asked.repartition(parts).withColumn("part", F.spark_partition_id()))
    out = None
    for part in range(parts if n else 0):
        some = asked.where(F.col("part") == part).select("vec_id", "v").toArrow()
        ids = some.column(0).to_numpy()
        queries = matrix(some.column(1).combine_chunks(), int(dims))
        lists = rows.select("vec_id", "v")
        groups_ = max(1, min(groups, int(dims)))
        kth = lists.mapInArrow(gather(ids, queries, groups_, k), "q int, kth double").groupBy("q").agg(F.max("kth").alias("kth")).collect()
        cutoff = np.full(len(ids), NONE)
        for r in kth:
            cutoff[r["q"]] = r["kth"]
        found = lists.mapInArrow(resolve(ids, queries, cutoff, groups_, k), "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        ranked = staged(ranked) if parts > 1 else ranked
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
