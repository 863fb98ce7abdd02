"""A training corpus from documents: toxic ones go, one of each group of near copies stays, benchmark leaks go, sources are mixed to
weights and the rows are dealt to shards. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, sharding, simhash, toxicity
from lodestone.llm.common import staged, table
from lodestone.llm.queries import remainder

SHARDS = 40


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.rejected(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def dealt(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards(docs, SHARDS)


STAGES = [("toxicity", clean), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", dealt)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, fingerprints and a keyed permutation aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
