"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..cluster import kept, shared_folder

#: Largest number of rows, and of bytes in them, that is broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


cut = kept


def stage_folder(spark: SparkSession) -> str:
    """A new folder for tables between stages, in the shared folder."""
    return f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"


def _held_bytes(df: DataFrame) -> Column:
    """Bytes of all rows: of texts as they are, of nested values as JSON, 16 for any other value."""
    sizes = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            own = F.octet_length(f.name)
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            own = F.octet_length(F.to_json(F.struct(f.name)))
        else:
            own = F.lit(16)
        sizes = sizes + F.coalesce(own, F.lit(0)).cast("long")
    return F.coalesce(F.sum(sizes), F.lit(0))


def is_small(kept: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    rows, size = kept.agg(F.count("*"), _held_bytes(kept)).first()
    return rows <= max_rows and size <= BROADCAST_BYTES


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` cut and, if its counted rows and the bytes of all its values are few, marked for broadcast; else joined by
    a shuffle."""
    kept = cut(df)
    return F.broadcast(kept) if is_small(kept, max_rows) else kept


#: Keys that more than one in so many rows have are joined by broadcast; there are at most so many of them.
HOT_SHARE = 1024


def with_value(rows: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns of ``values``, which has each of ``keys`` once and its number of ``times`` among ``rows``.

    Keys of many rows are broadcast: there are at most ``HOT_SHARE``, whatever the table's size. The others are joined
    by a shuffle, in which no key has more than a small share. Null keys join nothing.
    """
    values, on = cut(values), list(keys)
    total = values.agg(F.sum("times")).first()[0] or 0
    hot = F.col("times") > total / HOT_SHARE
    often = F.broadcast(values.where(hot).drop("times"))
    rest = rows.join(F.broadcast(values.where(hot).select(on)), on, "left_anti").join(values.where(~hot).drop("times"), on)
    return rows.join(often, on).unionByName(rest)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` sees runs of A-Z alone, so no other letter changes."""
    runs = F.regexp_extract_all(text, F.lit("([A-Z]+|[^A-Z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda p: F.when(F.ascii(p).between(65, 90), F.lower(p)).otherwise(p)), "")
