"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into buckets that fit in memory, by a seeded hash of each record's position,
so that no key, source or group of copies can fill a bucket. Pass two reads one bucket at a time, permutes it with a
seeded Fisher-Yates shuffle and writes it. Buckets follow one another; the record at place p of that global order
goes to shard p mod n and slot p div n, so shards differ by one record at most.

Both passes are functions of the input's files and the seed: a task that runs again writes the same records.

Null text has no bytes. Null or repeated ids are records like any other. An empty table gives no rows. Columns of the
input whose names clash with those added (bucket, place, shard, slot) are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import free_name, in_batches, materialize

_ADDED = ("bucket", "place", "shard", "slot")
#: Enough for 128 TB in buckets of 32 MB; give larger buckets beyond.
MOST_BUCKETS = 1 << 22


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A permutation of range(n): each place swaps with one drawn from those up to it."""
    order = list(range(n))
    draws = np.random.default_rng(seed).integers(0, np.arange(1, n + 1)).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def external_shuffle(df: DataFrame, size: Column, seed: int = 7, bucket_bytes: int = 32 << 20) -> DataFrame:
    """All records with bucket and place (their rank in the bucket after the shuffle), written to the shared folder.

    ``size`` is a record's bytes; buckets hold ``bucket_bytes`` of them on average. A table that needs more than
    MOST_BUCKETS is refused, as its buckets would not fit in memory.
    """
    df = df.drop(*_ADDED)
    at = free_name(df.columns, "_at")
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    if buckets > MOST_BUCKETS:
        raise ValueError(f"{total} bytes need {buckets} buckets, over {MOST_BUCKETS}: raise bucket_bytes")
    names = df.columns
    scattered = (
        df.withColumn(at, F.monotonically_increasing_id())
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), at), F.lit(buckets)).cast("int"))
        .repartitionById(buckets, "bucket")
        .sortWithinPartitions("bucket", at)
    )
    schema = scattered.select(*names, "bucket").withColumn("place", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                whole = pa.Table.from_batches(parts)
                order = fisher_yates(whole.num_rows, (seed, whole["bucket"][0].as_py()))
                for at in range(0, len(order), 2000):
                    out = whole.take(order[at : at + 2000])
                    out = out.append_column("place", pa.array(np.arange(at, at + out.num_rows)))
                    yield from out.combine_chunks().to_batches()

        kept: list[pa.RecordBatch] = []
        for b in batches:
            b = b.select([*names, "bucket"])
            ids = b["bucket"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    if kept and kept[0]["bucket"][0].as_py() != ids[lo]:
                        yield from flush(kept)
                        kept = []
                    kept.append(b.slice(lo, hi - lo))
        yield from flush(kept)

    return materialize(in_batches(scattered, run, schema), "shuffled")


def assign_shards(shuffled: DataFrame, shards: int) -> DataFrame:
    """Add shard and slot from bucket and place: the count of each bucket, a row a bucket, gives its offset.

    There are MOST_BUCKETS offsets at most (some 100 MB; 3,200 to the TB), so they are summed up in one task and broadcast,
    and the records stay where they are.
    """
    n, offset = (free_name(shuffled.columns, x) for x in ("_n", "_offset"))
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    rank = F.col(offset) + F.col("place")
    return (
        shuffled.join(F.broadcast(offsets), "bucket")
        .withColumn("shard", F.pmod(rank, F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(rank / shards).cast("long"))
        .drop(offset)
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a folder for each shard, its records in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
