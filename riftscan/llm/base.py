"""Shared helpers of the corpus operators.

Everything here is small: reading the tables, cutting lineage, binding a value
inside a column expression, and walking Arrow text batches in bounded slices.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.functions.lineage import cut  # noqa: F401  (operators take it from here)
from riftscan.functions.workers import importable

#: Code points of white space in the contracts' word patterns.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    Inside a lambda an outer expression would run again for each element; a
    lambda variable holds the computed value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, state: Column, item: str, step: Callable[[Column, Column], tuple[Column, Column]], chunk: int = 256) -> Column:
    """What a fold gives on its way, as one array of type ``item``.

    ``step(state, value)`` returns the next state and an array of what the
    value gives. Appending copies an array, so values are folded in chunks
    whose results are joined at the end: time is in proportion to ``values``
    but for one copied reference for each pair of chunks.
    """

    def inner(acc: Column, x: Column) -> Column:
        now, out = step(acc["state"], x)
        return F.struct(now.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, k: Column) -> Column:
        zero = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{item}>").alias("out"))
        part = F.aggregate(F.slice(values, k * chunk + 1, chunk), zero, inner)
        return let(part, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{item}>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int")), zero, outer, lambda acc: F.flatten(acc["out"]))


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns, and the whole row beside them as ``row``: no name of an operator's own can clash with the input's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of a packed row, some of them replaced."""
    return df.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])


#: Bytes of an Arrow batch that goes to a Python worker, unless the session has a lower bound.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose workers know this package and whose Arrow batches are bounded by bytes.

    Rows hold whole texts, so ten thousand of them may be far more than a
    worker should hold at once.
    """
    importable(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(re.sub(r"[^0-9]", "", conf.get(name)))
    except Exception as e:  # a release without the setting
        if "SQL_CONF_NOT_FOUND" not in str(e):
            raise
        return df
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a batch's text as (first row, bytes, offsets), each of about ``limit`` bytes.

    A row longer than ``limit`` is a slice of its own: rows are never divided.
    Null texts are empty.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
