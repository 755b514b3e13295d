"""Arrow batches inside tasks: bounded slices, added columns, text bytes as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from inspect import signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..cluster import ship

#: Bytes of one column that are worked on at once; a longer value is a slice of its own.
SLICE_BYTES = 1 << 20


@lru_cache(maxsize=1)
def _c_library() -> ctypes.CDLL | None:
    found = ctypes.CDLL(None)
    return found if hasattr(found, "malloc_trim") else None


def give_back() -> None:
    """Returns unused memory to the system: idle workers are kept alive and count against their executor."""
    pa.default_memory_pool().release_unused()
    if _c_library() is not None:
        _c_library().malloc_trim(0)


def frugal(task: Callable) -> Callable:
    """``task``, a function of ``applyInArrow``, that gives memory back when a group is done."""

    def done(*args):
        try:
            return task(*args)
        finally:
            give_back()

    # Spark reads the kind of a grouped function off its number of parameters
    kinds = {1: lambda rows: done(rows), 2: lambda key, rows: done(key, rows), 3: lambda key, left, right: done(key, left, right)}
    return kinds[len(signature(task).parameters)]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in order, cut where ``column`` would exceed ``limit`` bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The values as strings; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def flat_bytes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All values one after another as bytes, and the offset of each (one more than there are rows)."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, at - at[0]


def with_column(df: DataFrame, source: str, name: str, kind: str, values: Callable[[list], list | pa.Array], strings: bool = True, drop: bool = False, limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with ``name`` computed from ``source`` slice by slice, without ``source`` if ``drop``. ``values`` gets texts or bytes."""
    kept = [f for f in df.schema.fields if f.name != name and not (drop and f.name == source)]
    schema = StructType([*kept, StructField(name, _parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, source, limit):
                raw = part.column(part.schema.get_field_index(source)).to_pylist()
                made = values([x or ("" if strings else b"") for x in raw])
                made = made if isinstance(made, pa.Array) else pa.array(made, out.field(name).type)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept] + [made]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, out, strict=True)], schema=out)
                del raw, made, columns

    return in_arrow(df, run, schema)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)
