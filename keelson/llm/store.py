"""Batches of bounded size for Python workers, and the shared tables of the library under one name."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.tables import drop, fresh, keep, parts, put, scratch, shared_dir

__all__ = ["drop", "forget", "fresh", "held", "in_arrow", "keep", "parts", "put", "scratch", "shared_dir", "spare", "tidy"]

#: Bytes of rows that Spark hands to a Python worker at a time, unless the session says otherwise; a longer row comes alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def tidy() -> None:
    """Gives free memory of this worker back to the system, where the allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_held: dict = {}


def held(key, make: Callable):
    """What make() gives, kept in this worker over batches and tasks until something else is, or forget() is called."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    _held.clear()


def in_arrow(df: DataFrame, run: Callable, schema, model: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of at most BATCH_BYTES, unless the session sets that itself.

    A worker that an operator with a model has used before drops that, unless `model` says that this one has one, too.
    """
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not model:
            forget()
        yield from run(batches)
        tidy()

    return df.mapInArrow(tidied, schema)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as make it differ from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
