"""Counts by hash bucket of all values of a table, as one array of fixed size.

Tasks count into arrays and hand on their pieces; a second step adds up the pieces. What reaches
the driver, and from there the executors, has the size of one array whatever the table holds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 14
SCHEMA = "chunk int, counts binary"


def buckets(values: np.ndarray, width: int) -> np.ndarray:
    """The bucket of each unsigned 64-bit value; width is a power of two."""
    return (values.astype(np.uint64, copy=False) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


def chunk_rows(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Pieces of an array that hold anything."""
    for start in range(0, len(counts), CHUNK):
        part = counts[start : start + CHUNK]
        if part.any():
            yield start // CHUNK, part.astype("<i4").tobytes()


def added(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of all pieces (chunk, counts)."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(counts, "<i4").astype(np.int64)
                sums[chunk] = sums[chunk] + piece if chunk in sums else piece
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"]
            )

    total = np.zeros(width, np.int64)
    parts = max(1, width // CHUNK)
    for row in rows.select("chunk", "counts").repartition(parts, "chunk").mapInArrow(add, SCHEMA).collect():
        start = row["chunk"] * CHUNK
        piece = np.frombuffer(row["counts"], "<i8")
        total[start : start + len(piece)] += piece
    return total


def counted(values: DataFrame, width: int) -> np.ndarray:
    """Counts by bucket of a table with one column of longs."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts += np.bincount(buckets(own, width), minlength=width)
        chunks = list(chunk_rows(counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in chunks], pa.int32()), pa.array([b for _, b in chunks], pa.binary())], names=["chunk", "counts"]
        )

    return added(values.mapInArrow(count, SCHEMA), width)
