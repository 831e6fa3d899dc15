"""Shared plumbing of the llm operators: tables, the shared work folder and bounded key filters.

Every operator that must cut lineage or read a result twice writes it with ``materialize`` into the folder named by
``spark.checkpoint.dir``, which driver and executors share, so a lost executor loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanewright.sources.shared import discard, materialize, shared_dir, tasks_for

__all__ = ["KeyBitmap", "bound_batches", "discard", "free_name", "in_batches", "materialize", "shared_dir", "table", "tasks_for", "text_or_empty", "without_keys"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's readers know."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB (a batch goes over it by one row at most), unless the session says otherwise: Spark
    alone bounds them by rows, however long the texts are."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(4 << 20))


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded bytes."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_or_empty(column: str | Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no name in ``taken`` is equal to it, as Spark compares names."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def without_keys(df: DataFrame, keys: DataFrame, column: str, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` whose ``column`` is none of ``keys`` (distinct longs). Up to ``most_broadcast`` of them, counted
    once they are written (some 50 MB), are broadcast, so that wide rows stay where they are; more are shuffled."""
    keys = materialize(keys.select(column), "keys", tasks_for(df, 0.1))
    return df.join(F.broadcast(keys) if keys.count() <= most_broadcast else keys, column, "left_anti")


class KeyBitmap:
    """A set of 64-bit hashes folded into ``2**log2_bits`` bits: a filter without false negatives.

    Its size is fixed (2 MB by default, 16 million bits), so it may be sent to every task however many keys there
    are. With very many keys it fills up and lets more through; what it lets through is joined exactly afterwards.
    """

    def __init__(self, words: np.ndarray, log2_bits: int) -> None:
        self.words, self.log2_bits = words, log2_bits

    @classmethod
    def of(cls, df: DataFrame, hash_column: str, log2_bits: int = 24) -> KeyBitmap:
        """Build from a long column; at most ``2**(log2_bits - 6)`` longs reach the driver."""
        bit = F.col(hash_column).bitwiseAND((1 << log2_bits) - 1)
        rows = (
            df.where(F.col(hash_column).isNotNull())
            .select(F.shiftright(bit, 6).cast("int").alias("word"), bit.alias("bit"))
            .groupBy("word")
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
            .collect()
        )
        words = np.zeros(1 << (log2_bits - 6), np.int64)
        for word, mask in rows:
            words[word] = mask
        return cls(words.view(np.uint64), log2_bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For each int64 or uint64 hash, whether a key with those bits may be present."""
        bit = hashes.view(np.uint64) & np.uint64((1 << self.log2_bits) - 1)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
