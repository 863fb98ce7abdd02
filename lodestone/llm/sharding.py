"""A reproducible shuffle into shards: a Feistel permutation of global row numbers, with cycle walking.

Row numbers follow the rows' contents, not their files: two 64-bit hashes stand for a row. Equal rows are counted first (they can be
told apart by nothing, and a
third of all rows may be equal), distinct pairs of hashes are dealt to buckets, numbered there, and shifted by the buckets before;
the rows themselves,
one of equal ones from each task, move once, to their numbers.
The number x = L * a + R, with a * a just over the number of rows, goes through rounds (L, R) -> (R, (L + f(R)) mod a), a permutation
of [0, a * a). A result beyond the rows goes through it again until it isn't; less than 2 * sqrt(rows) numbers need that. Shard
and slot are the remainder and the quotient by the number of shards, so shards differ by one row at most and slots have no gap;
any row number's place, and any place's row number, can be computed alone.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import packed, parallelism, staged, unpacked
from lodestone.llm.numbering import with_offsets

ROUNDS = (11, 23, 37, 53, 71, 97)
#: Copies of one row that are written out by one task.
RUN = 4096
#: Steps of a walk that are always taken side by side; hardly a row needs more than two.
STEPS = 16


def feistel(x: Column, a: int, seed: int, rounds: tuple[int, ...] = ROUNDS) -> Column:
    """A permutation of [0, a * a)."""

    def round_(x: Column, key: Column) -> Column:
        left, right = F.round((x - x % F.lit(a)) / F.lit(a)), x % F.lit(a)
        return right * F.lit(a) + (left.cast("long") + F.pmod(F.xxhash64(right, key, F.lit(seed)), F.lit(a))) % F.lit(a)

    return F.aggregate(F.array(*(F.lit(k).cast("long") for k in rounds)), x, round_)


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """x, from [0, n), under a permutation of [0, n)."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)

    def walked(x: Column, steps: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), steps), x, lambda y, _: F.when(y < n, y).otherwise(feistel(y, a, seed)))

    most = max(1, a * a - n)  # a walk leaves the numbers beyond n after so many steps at the latest
    once = feistel(x, a, seed)
    some = walked(once, F.lit(min(STEPS, most)))
    # the length of the rare longer walk hangs on the row, so that it isn't made for all rows, nor in advance
    return F.when(once < n, once).when(some < n, some).otherwise(walked(once, (F.lit(most) + x % F.lit(1)).cast("int")))


def numbered(rows: DataFrame) -> DataFrame:
    """``row`` (rows' columns as one) and ``number``, from 0, by their contents alone. Equal rows get neighbouring numbers."""
    hashed = rows.select(packed(rows)).withColumns({"h": F.xxhash64("row"), "h2": F.xxhash64(F.lit(1), "row")})
    bits = max(1, (parallelism(rows) * 4).bit_length())  # a bucket is a range of hashes, so their number doesn't bear on the order
    distinct = staged(hashed.groupBy("h", "h2").agg(F.count("*").alias("times")).withColumn("bucket", F.shiftright("h", 64 - bits).cast("int")))
    offsets = with_offsets(distinct.groupBy("bucket").agg(F.sum("times").alias("n")), "bucket", "n")
    order = Window.partitionBy("bucket").orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, -1)
    numbers = distinct.withColumn("start", F.coalesce(F.sum("times").over(order), F.lit(0))).join(offsets, "bucket").select("h", "h2", "times", (F.col("start") + F.col("offset")).alias("number"))
    started = hashed.dropDuplicates(["h", "h2"]).join(numbers, ["h", "h2"])
    runs = started.select("row", "number", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(RUN).cast("long"))).alias("k"))
    few = runs.where(f"times <= {RUN}")
    many = runs.where(f"times > {RUN}").repartition(F.col("k"), F.col("number"))
    copies = F.sequence(F.col("k"), F.least(F.col("k") + RUN, F.col("times")) - 1)
    return few.unionByName(many).select("row", "number", F.explode(copies).alias("k")).select("row", (F.col("number") + F.col("k")).alias("number"))


def shards(rows: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """rows with ``shard`` (int, from 0) and ``slot`` (long, without gaps from 0).

    Columns may have any names; those named shard or slot are replaced. Map-typed columns aren't supported. Nulls are values like
    any other; rows that repeat
    each get their own slot. No row: no row.
    """
    rows = rows.drop("shard", "slot")
    place = permuted(F.col("number"), rows.count(), seed)
    placed = numbered(rows).select("row", place.alias("place"))
    return placed.select(*unpacked(rows.columns), (F.col("place") % n_shards).cast("int").alias("shard"), F.expr(f"place div {n_shards}").alias("slot"))
