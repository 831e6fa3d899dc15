"""Sequential work per group without a Python call per Spark group: partitions are sorted and streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rows = Iterable[tuple]
#: Rows and elements of their lists that are held before they are passed on.
MOST_HELD = 20_000


def _tasks(df: DataFrame, spread: bool) -> list[int]:
    spark = df.sparkSession
    return [max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)] if spread else []


def map_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, dict[str, np.ndarray]], Rows], schema: str, spread: bool = False) -> DataFrame:
    """``work(key, columns)`` for each group, its rows in ``order``; it gives rows of ``schema``.

    One shuffle on the keys; ``spread``: by a fixed number of tasks, for work that takes long on few bytes, which would
    otherwise be put together into as few tasks as its bytes fill. A worker holds one group at a time, so memory is bounded by the largest group (a scene, a
    vehicle), not by a partition; rows with long lists are passed on sooner. Null keys are a group.
    """
    names = df.columns
    target = to_arrow_schema(StructType.fromDDL(schema))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in target]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def finish() -> Rows:
            whole = pa.Table.from_batches(parts)
            return work(now, {c: whole[c].to_numpy() for c in names})

        rows: list[tuple] = []
        held = 0

        def add() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held
            for row in finish():
                rows.append(row)
                held += 1 + sum(len(v) for v in row if isinstance(v, list))
                if len(rows) >= 5000 or held >= MOST_HELD:
                    yield out(rows)
                    rows, held = [], 0

        for b in batches:
            if not b.num_rows:
                continue
            ids = list(zip(*(b[k].to_pylist() for k in keys), strict=True))
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if parts and ids[lo] != now:
                    yield from add()
                    parts = []
                now = ids[lo]
                parts.append(b.slice(lo, hi - lo))
        if parts:
            yield from add()
        yield out(rows)

    return df.repartition(*_tasks(df, spread), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: Rows of whole groups that :func:`map_chunks` hands over together, if one group does not have more.
LEAST = 50_000


def map_chunks(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], Iterable[dict]], schema: str, spread: bool = False) -> DataFrame:
    """``work(rows, group)`` for many whole groups at a time; it gives columns of ``schema`` as arrays.

    For kernels that judge small groups together: ``group`` numbers each row's group, ascending. One shuffle on the keys,
    ``spread`` as for :func:`map_groups`; a worker holds ``LEAST`` rows, or the largest group.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def groups(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        for k in keys:
            codes = rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held, enough = 0, LEAST

        def out(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            for found in work(rows, group):
                yield from pa.table([pa.array(found[f.name], f.type) if isinstance(found[f.name], np.ndarray) else found[f.name] for f in target], schema=target).to_batches(max_chunksize=1 << 16)

        for b in batches:
            if b.num_rows:
                parts.append(pa.Table.from_batches([b]))
                held += b.num_rows
            if held >= enough:
                rows = pa.concat_tables(parts)
                group = groups(rows)
                cut = int(np.searchsorted(group, group[-1]))
                if cut:
                    yield from out(rows.slice(0, cut), group[:cut])
                parts, held = [rows.slice(cut)], len(rows) - cut
                enough = max(LEAST, 2 * held)
        if held:
            rows = pa.concat_tables(parts)
            yield from out(rows, groups(rows))

    return df.repartition(*_tasks(df, spread), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
