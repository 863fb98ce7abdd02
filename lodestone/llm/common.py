"""Helpers the operators of this subpackage share: reading, staging, Arrow batches, words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.staging import deleted, scratch, shared_folder, staged, written

__all__ = ["deleted", "scratch", "shared_folder", "staged", "written"]

#: One word of a text. Java's regex and DuckDB's agree on it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, and about so many bytes, at most: rows hold whole texts of any length."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def packed(df: DataFrame, name: str = "row") -> F.Column:
    """All of a row's columns in one, so that none clashes with an operator's own; ``unpacked`` undoes it."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def unpacked(columns: list[str], name: str = "row") -> list[F.Column]:
    return [F.col(name)[c].alias(c) for c in columns]


def parallelism(df: DataFrame) -> int:
    """Shuffle partitions that grow with the input: the configured number, or the scan's splits if they are more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def ascii_lower(c) -> F.Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and for each text how many are its own. A null text has none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    owner = pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full, min_count=0).as_py():
        words, owner = words.filter(full), owner.filter(full)
    return words, np.bincount(owner.to_numpy(), minlength=len(texts)).astype(np.int64)


def encoded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A code for each word, and the words that the codes stand for."""
    found = words.dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of 64-bit hashes, in that order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
