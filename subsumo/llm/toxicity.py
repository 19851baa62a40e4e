"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed words, pairs of neighbours and pairs with one or two words
between them. Every coordinate has its own learning rate; the L1 term leaves most weights
at exactly zero, so what is sent to the executors is a short list of coordinates.

Training reads a bounded sample of labelled rows: `training_rows`, those with the smallest hash
of their id, in that order. FTRL goes over rows one after another, so this bounded sample is
one task's work, which keeps the rows' coordinates in a file of its own between the passes.
Scoring reads whole texts, all of them. Inputs are texts only.

Nulls are empty texts, which get the score of the intercept. Rows that repeat are scored
each; a document with several labels is toxic if one of them says so. Without labelled
rows the score is that of a prior below one half. Held out: crc32 of the id as text, modulo
5, is 0; a null id is not held out.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsumo.llm.common import Query, mixed, small_batches, table, text_bytes, word_hashes

#: Bits of a coordinate; labelled rows that training reads at most; passes over them.
BITS, TRAINING_ROWS, PASSES = 22, 20_000, 2
#: Rate, its start, L1 and L2 of FTRL-proximal.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1
FOLDS = 5

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))


def coordinates(text: bytes, bits: int = BITS) -> np.ndarray:
    """Coordinates of all words, pairs and skip-grams, with repetitions."""
    hashes = word_hashes(text.translate(_PLAIN).split())
    parts = [mixed(hashes)]
    for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA5A3564E1B8F9C6D), (3, 0xC2B2AE3D27D4EB4F)):
        if len(hashes) > gap:
            parts.append(mixed(hashes[:-gap] * np.uint64(factor) + hashes[gap:]))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Weights:
    """Non-zero weights by coordinate, and the intercept."""

    at: np.ndarray
    value: np.ndarray
    intercept: float
    bits: int = BITS

    @cached_property
    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.at] = self.value
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "dense"}

    def margin(self, text: bytes) -> float:
        found = coordinates(text, self.bits)
        found = np.unique(found[self.dense[found] != 0])
        return self.intercept + float(self.dense[found].sum())

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(text), -30, 30))))


def ftrl(
    rows: Iterable[tuple[np.ndarray, float]], intercept: float, bits: int = BITS, passes: int = PASSES,
    alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2,
) -> Weights:
    """Weights after some passes over rows of (distinct coordinates, label) in the given order."""
    z, squares = np.zeros(1 << bits), np.zeros(1 << bits)
    intercept_squares = 0.0

    def weights(z, squares):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(squares)) / alpha + l2))

    for at, label in (row for _ in range(passes) for row in rows):
        before, seen = z[at], squares[at]
        w = weights(before, seen)
        gradient = 1 / (1 + np.exp(-np.clip(intercept + w.sum(), -30, 30))) - label
        now = seen + gradient * gradient
        z[at] = before + gradient - (np.sqrt(now) - np.sqrt(seen)) / alpha * w
        squares[at] = now
        intercept_squares += gradient * gradient
        intercept -= alpha / (beta + np.sqrt(intercept_squares)) * gradient
    at = np.flatnonzero((z > l1) | (z < -l1))
    return Weights(at, weights(z[at], squares[at]), intercept, bits)


class StoredRows:
    """Rows of (distinct coordinates, label) in a file, read again in the order they came."""

    def __init__(self, file):
        self.file, self.lengths, self.labels = file, [], []

    def add(self, at: np.ndarray, label: float) -> None:
        self.file.write(at.astype(np.int32).tobytes())
        self.lengths.append(len(at))
        self.labels.append(label)

    def __iter__(self) -> Iterator[tuple[np.ndarray, float]]:
        self.file.seek(0)
        for n, label in zip(self.lengths, self.labels):
            yield np.frombuffer(self.file.read(4 * n), np.int32), label


def learned(batches: Iterable[pa.RecordBatch], bits: int = BITS, passes: int = PASSES) -> Weights:
    """Weights from batches of texts and labels, in the order of training.

    A Python worker stays for later stages with the memory that it once took, so the rows are kept in a file."""
    with tempfile.TemporaryFile() as file:
        seen = StoredRows(file)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.add(np.unique(coordinates(text, bits)), label)
        toxic = sum(seen.labels)
        return ftrl(seen, float(np.log((toxic + 1) / (len(seen.labels) - toxic + 2))), bits, passes)


def fold_of(id_column: str | Column) -> Column:
    id_column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS


def train(
    documents: DataFrame, labels: DataFrame, *, label_column: str = "toxic", training_rows: int = TRAINING_ROWS,
    passes: int = PASSES, bits: int = BITS,
) -> Weights:
    """Weights from labelled rows outside the held-out fold."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = (
        labels.where(F.col(label_column).isNotNull() & (fold_of("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.max(F.col(label_column).cast("double")).alias("label"))
        .orderBy(order, "doc_id")
        .limit(training_rows)
    )
    # At most training_rows pairs of an id and a label; of repeated rows each is one.
    rows = documents.select("doc_id", text_bytes().alias("text")).join(F.broadcast(known), "doc_id")
    in_order = rows.repartition(1).sortWithinPartitions(order, "doc_id", "text").select("text", "label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = learned(batches, bits, passes)
        yield pa.RecordBatch.from_pydict({"at": [found.at], "value": [found.value], "intercept": [found.intercept]})

    # One row: the non-zero weights, of at most 2 ** bits coordinates.
    with small_batches(documents.sparkSession):
        row = in_order.mapInArrow(learn, "at array<bigint>, value array<double>, intercept double").first()
    if row is None:
        return Weights(np.zeros(0, np.int64), np.zeros(0), float(np.log(0.5)), bits)
    return Weights(np.asarray(row["at"], np.int64), np.asarray(row["value"]), row["intercept"], bits)


def score_of(text: Column, weights: Weights) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(weights.score)

    return score(text_bytes(text))


def score_documents(documents: DataFrame, weights: Weights) -> DataFrame:
    scored = documents.select(
        "doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), score_of(F.col("text"), weights).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(documents: DataFrame, weights: Weights) -> DataFrame:
    """All columns of the documents whose score is below one half."""
    return documents.where(score_of(F.col("text"), weights) < 0.5)


def _query(spark, sf):
    documents = table(spark, sf, "documents")
    return score_documents(documents, train(documents, table(spark, sf, "labels")))


QUERIES = {"op6_toxicity_scores": Query(_query)}
