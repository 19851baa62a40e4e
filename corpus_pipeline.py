"""A training corpus from documents in five stages, each on all that the one before it kept.

Toxic documents go; of each group of near duplicates one stays; secrets are replaced by a mark;
sources are mixed to their target weights (documents repeat or fall out as wholes); what is
left is encoded. Each stage's rows are written and read again, so a stage's work is not
repeated and a lost executor costs its tasks only.

A stage's rows are made when the caller writes them. So that whole texts do not fill the executors'
memory then, each stage sets the session's Arrow batches to a few megabytes; `run` sets them back."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subsumo.llm import bpe, jaccard, mixing, secrets, toxicity
from subsumo.llm.common import Query, keep_batches_small, small_batches, table
from subsumo.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        keep_batches_small(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@in_small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs, count_column="n_chars")


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL cannot express the trained model, the token ratios and the encoding; tests cover them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for _, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir))
    return docs


QUERIES: dict[str, Query] = {"pipeline": Query(run)}
