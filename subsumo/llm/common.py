"""Shared small parts: scans of texts as bytes in Arrow batches, word hashes, registered queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words are split at these ASCII characters, as bytes.split() does.
SPACES = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: Callable[[], str] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record(df: DataFrame) -> Column:
    """All columns as one struct, whose names cannot meet those that an operator uses inside."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("record")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, Spark removes a statement's shuffle files when the statement is done.

    For chains of written tables: what a step has shuffled is of no use once its table is there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of an Arrow batch of rows that may be long. Buffers on both sides of a task are a small multiple of it.
BATCH_BYTES = 1 << 22
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep_batches_small(spark: SparkSession) -> None:
    """As small_batches, for a session from now on: for jobs that own it, whose rows are made when the caller writes them."""
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, Arrow batches hold some megabytes, however long their rows are.

    Spark's own limits are 10,000 rows and 64 MB; buffers that double while they fill, in every task and
    its Python worker, then take hundreds of megabytes of an executor beside its heap."""
    before = spark.conf.get(_BATCH_SETTING)
    keep_batches_small(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def text_bytes(column: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text, none for null: tasks then need no decoding."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def scan(
    documents: DataFrame, columns: Sequence[Column], schema: str, each: Callable[[dict[str, list]], dict[str, Sequence]]
) -> DataFrame:
    """Maps Arrow batches of the columns, as lists of Python values, to lists of results.

    Batches are cut so that a task holds some megabytes of text at a time."""
    chosen = documents.select(*columns)
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            result = each({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(result[f.name], type=f.type) for f in arrow], schema=arrow)

    return chosen.mapInArrow(run, out)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_lower(text: bytes) -> bytes:
    """A-Z only, whatever else the text holds."""
    return text.translate(_LOWER)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _SECOND
    return values ^ (values >> np.uint64(27))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` words; for fewer words one of the whole sequence."""
    if len(hashes) == 0:
        return hashes
    size = min(width, len(hashes))
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed((out ^ hashes[i : len(hashes) - size + 1 + i]) * _MULTIPLIER)
    return out
