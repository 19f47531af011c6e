"""Arrow batches inside tasks, taken and given in small parts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Rows of a batch that are Python objects at a time; characters and rows of a batch made here.
ROWS, CHARS, MOST_ROWS = 64, 4 << 20, 4096


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of batches as tuples. Spark's batches have up to 64 MB; few rows of one are held twice."""
    for batch in batches:
        own = batch.select(columns)
        for i in range(0, own.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in own.slice(i, ROWS).columns))


def batches_of(rows: Iterable[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Batches of many small rows; ``text`` is the place of the column whose characters count."""
    lot, held = [], 0
    for row in rows:
        lot.append(row)
        held += len(row[text] or "")
        if held >= CHARS or len(lot) >= MOST_ROWS:
            yield _batch(lot, schema)
            lot, held = [], 0
    if lot:
        yield _batch(lot, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


#: What this worker process keeps from task to task, by `kept`.
_kept: dict = {}


def kept(key: tuple, make: Callable):
    """What ``make`` gave when a task first asked for ``key``; a worker keeps one such thing.

    It stays until a task asks for another or calls `give_back` without this key.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back(key: tuple | None = None) -> None:
    """Hand back what a task has freed: its worker process lives on and takes later tasks.

    What is kept goes, too, unless it is kept under ``key``.
    """
    import ctypes
    import gc

    for other in [k for k in _kept if k != key]:
        del _kept[other]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
