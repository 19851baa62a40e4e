"""Session helpers: the shared folder, tables written to it and small driver-made tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that lineage is cut to.

    A cluster names a shared folder in ``spark.checkpoint.dir`` and that one is used.
    Only a local session without the setting gets a fresh folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="subsumo-checkpoint-")
    context.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_folder(spark)}/subsumo-{kind}-{uuid.uuid4()}"


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Computes once and cuts the lineage: a Parquet table in the shared folder.

    Unlike cached blocks it outlives executors, and unlike a checkpoint it has a known
    size, so that joins with small results broadcast. With a given folder, rows are added
    to those that are there and all of them are returned."""
    folder = folder or new_folder(df.sparkSession, "table")
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def counted(df: DataFrame, folder: str | None = None) -> tuple[DataFrame, int]:
    """As :func:`materialize`, with the number of rows that this call wrote, taken while writing."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), folder)
    return written, seen.get["n"]


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A local relation from rows that are bounded by the caller (metadata, one chunk).

    Going through Arrow gives the optimizer the true size, so joins with it broadcast."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))
