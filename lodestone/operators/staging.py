"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Open scopes, the innermost last; each lists the tables written within it.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """What the cluster's spark.checkpoint.dir names. An own folder only where that is unset and all executors run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='lodestone-')}")
    return sc.getCheckpointDir()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as ``staged`` gives it, and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts the lineage, so that a lost executor costs no more than the
    tasks after it, and
    what follows sees one and the same set of rows however often it reads them."""
    out, path = written(df)
    if _scopes:
        _scopes[-1].append(path)
    return out


def deleted(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Staged tables of the operators that are built *and written out* within the scope are deleted on leaving it."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        deleted(spark, *paths)
