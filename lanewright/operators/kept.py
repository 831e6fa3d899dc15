"""Tables that operators read more than once: written where driver and executors share them, and their release.

A kept table is written at once and its plan ends there. So a scene's operators, which build on each other's tables
several times over, have small plans, and nothing is worked out twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from lanewright.sources.shared import discard, materialize

_OPEN: list[list[DataFrame]] = [[]]


def keep(df: DataFrame, label: str = "kept") -> DataFrame:
    """Write a table and read it back; its files go when the innermost :func:`kept` block ends, or by :func:`release`.

    Joins with it are merged, never broadcast: the planner goes by the bytes of its files, and repeated names and numbers
    take a hundredth of their memory there.
    """
    found = materialize(df, label)
    _OPEN[-1].append(found)
    return found.hint("merge")


def release() -> None:
    """Delete what was kept outside any block: call it once results are written."""
    discard(*_OPEN[0])
    _OPEN[0].clear()


@contextmanager
def kept() -> Iterator[None]:
    """Delete at the end what operators have kept inside the block; write or collect their results within."""
    _OPEN.append([])
    try:
        yield
    finally:
        discard(*_OPEN.pop())
