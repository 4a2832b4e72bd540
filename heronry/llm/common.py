"""Helpers that several corpus operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z on UTF-8 bytes; other letters keep their case.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def as_row(df: DataFrame, **columns: str) -> DataFrame:
    """The whole rows of `df` in the struct `row`, beside the named columns, so that no name in `df` meets one of ours."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(F.col(f"`{c}`").alias(name) for name, c in columns.items()))


def with_columns(schema: T.StructType, added: list[T.StructField]) -> T.StructType:
    """`schema` with columns of our own; they replace columns of the same name."""
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + added)


def add_arrays(batch: pa.RecordBatch, schema: T.StructType, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """`batch` with the columns in `added`, in the order of `schema`."""
    names = batch.schema.names
    arrays = [added[f.name] if f.name in added else batch.column(names.index(f.name)) for f in schema.fields]
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])


def text_buffers(column: pa.Array):
    """Offsets and UTF-8 bytes of a string column; nulls have no bytes."""
    import numpy as np

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def pack_bounds(sizes, most: int):
    """Cut consecutive rows into runs whose sizes add up to about `most`; one row may be larger."""
    import numpy as np

    ends = np.cumsum(sizes)
    bounds, done = [0], 0
    while bounds[-1] < len(sizes):
        nxt = int(np.searchsorted(ends, done + most, side="right"))
        nxt = max(nxt, bounds[-1] + 1)
        bounds.append(nxt)
        done = int(ends[nxt - 1])
    return bounds


def text_bytes(df: DataFrame, column: str) -> int:
    """Total UTF-8 bytes of a column."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def drop_path(spark, path: str) -> None:
    """Deletes a folder in the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
