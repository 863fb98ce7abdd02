"""Mixing sources to target weights by hash-threshold histograms.

Sources share a budget by weight; what a source can't use, as it may be repeated only so often, is shared again among the others.
A source's whole copies are taken first; for the rest, its documents have a fixed random place (60 bits of a hash), and those
below the source's threshold are taken once more. The threshold is found without a sort: sizes are summed by source and by
the place's first 12 bits, the bucket that holds the budget's end is found and only this one is split by the next 12 bits, until
it holds one document (or equal ones), which is in if that brings the sum nearer. A larger budget takes a superset.

Sums are pre-aggregated before they are shuffled, so a hot source costs no more than 4,096 rows for each task. To the driver come
sums over all sources and a count of unfinished ones, never sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, packed, staged, unpacked
from lodestone.llm.numbering import ranked

PLACE_BITS, STEP = 60, 12
WEIGHTS = (5, 2, 1)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(*of: Column, seed: str = "mix") -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 64 - PLACE_BITS)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeat: float) -> DataFrame:
    """sizes (source, source_size), one row each, with ``target``. Sources weigh ``weights`` by turns, by code point, null last."""
    turns = F.array(*(F.lit(float(w)) for w in weights))
    rows = staged(ranked(sizes, [F.col("source").asc_nulls_last()], "rank").withColumn("weight", F.element_at(turns, (F.col("rank") % len(weights) + 1).cast("int"))))
    most = repeat * F.col("source_size")
    budget = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, before = -1.0, None
    while level != before:  # each turn fixes the sources that can't use their share; there are no more turns than sources
        before, full = level, most <= level * F.col("weight")
        used, free = rows.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        level = max(level, (budget - (used or 0)) / free)
    return rows.select("source", "source_size", F.least(most, level * F.col("weight")).alias("target"))


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """For each source: source_size, target, ``copies`` (of each of its documents) and ``cut`` (documents placed below it get one more).
    sized: source, size (long), place, staged."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets(sums, weights, share, repeat).withColumn("copies", whole).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = staged(state.select("*", F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("cut")))
    for bits in range(PLACE_BITS - STEP, -1, -STEP):
        open_ = state.where("cut is null").select(F.col("source").alias("s"), "low", "rest")
        inside = sized.join(open_, sized["source"].eqNullSafe(open_["s"]) & (F.shiftright("place", bits + STEP) == F.shiftright("low", bits + STEP)))
        counts = inside.groupBy("s", "low", "rest", F.shiftright("place", bits).alias("bucket")).agg(F.sum("size").alias("size"), F.min("place").alias("first"), F.max("place").alias("last"))
        upto = Window.partitionBy("s").orderBy("bucket")
        summed = counts.withColumn("before", F.sum("size").over(upto) - F.col("size"))
        edge = summed.where("before <= rest").groupBy("s").agg(F.max(F.struct("bucket", "before", "size", "first", "last")).alias("edge"))
        left = F.col("rest") - F.col("edge.before")
        done = F.when(F.col("edge.size") <= left, F.col("edge.last") + 1).when((F.col("edge.first") == F.col("edge.last")) | F.lit(bits == 0), F.col("edge.first") + (2 * left > F.col("edge.size")).cast("long"))
        found = edge.join(open_, F.expr("edge.bucket is not null") & edge["s"].eqNullSafe(open_["s"])).select(edge["s"], done.alias("new_cut"), F.shiftleft(F.col("edge.bucket"), bits).alias("new_low"), left.alias("new_rest"))
        named = state.join(found, state["source"].eqNullSafe(found["s"]), "left")
        state = staged(named.select("source", "source_size", "target", "copies", F.coalesce("new_rest", "rest").alias("rest"), F.coalesce("new_low", "low").alias("low"), F.coalesce("cut", "new_cut").alias("cut")))
        if state.where("cut is null").isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", F.coalesce("cut", F.lit(0)).alias("cut"))


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with source and place) and for each how often it is taken (``taken_times``), source_size and target."""
    p = plan.withColumnRenamed("source", "__source")
    extra = F.col("copies") + (F.col("place") < F.col("cut")).cast("long")
    return rows.join(p, rows["source"].eqNullSafe(p["__source"])).withColumn("taken_times", extra).drop("__source", "copies", "cut")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """id, source, size (words), place, source_size, target and taken_times of each document.

    Null or blank texts have size 0. Null sources are one source, the last. Sources whose texts are all blank have target 0. Rows that
    repeat share a place, so they are taken alike. A source's sum misses its target by half of one document (or one group of equal rows) at
    most. No row: no row.
    """
    t = F.col(text)
    sized = staged(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), words_in(t).alias("size"), place(F.col(doc_id), t).alias("place")))
    return mixed(sized, mix_plan(sized.select("source", "size", "place"), weights, share, repeat))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """docs, each row as often as the mix takes it; all columns as they were. Cases as in ``mix``."""
    t, where = F.col(f"`{text}`"), place(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    rows = docs.select(packed(docs), F.col(f"`{source}`").alias("from"), words_in(t).alias("size"), where.alias("place"))
    plan = mix_plan(staged(rows.select(F.col("from").alias("source"), "size", "place")), weights, share, repeat)
    taken = rows.join(plan, F.col("from").eqNullSafe(F.col("source"))).withColumn("times", F.col("copies") + (F.col("place") < F.col("cut")).cast("long"))
    return taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("k")).select(*unpacked(docs.columns))
