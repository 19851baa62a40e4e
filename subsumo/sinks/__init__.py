"""Where results go: tables that persist, and callbacks at the edge of the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from subsumo.session import small_table
from subsumo.sources.tables import TableSet


def _stamped(inds: DataFrame, algorithm: str, dataset: str, run_id: str) -> DataFrame:
    return inds.select(
        F.lit(run_id).alias("run_id"), F.lit(algorithm).alias("algorithm"), F.lit(dataset).alias("dataset"),
        F.current_timestamp().alias("created_at"), "*",
    )


def save(
    inds: DataFrame, path: str | None = None, table: str | None = None, algorithm: str = "discover", dataset: str = "",
    run_id: str | None = None,
) -> str:
    """Appends results under a run id, with date, algorithm and data set name, to a folder or table."""
    run_id = run_id or str(uuid.uuid4())
    writer = _stamped(inds, algorithm, dataset, run_id).write.mode("append").format("parquet")
    if (path is None) == (table is None):
        raise ValueError("give either a path or a table")
    if path is not None:
        writer.save(path)
    else:
        writer.saveAsTable(table)
    return run_id


# --- collections --------------------------------------------------------------------

#: The tables of a folder of collections, each partitioned by collection.
_PARTS = ("constraints", "columns", "runs")


def save_collection(
    inds: DataFrame, folder: str, collection: str, tables: TableSet, algorithm: str = "discover", dataset: str = "",
    settings: dict[str, str] | None = None,
) -> None:
    """Stores results under a name, with the columns they speak of and how they were found.

    A collection that is there already is replaced, in its own partitions; all others stay.
    The run is written last, so a collection without one was not finished."""
    spark = tables.spark
    schema = pa.schema([("algorithm", pa.string()), ("dataset", pa.string()), ("settings", pa.map_(pa.string(), pa.string())), ("created_at", pa.timestamp("us", "UTC"))])
    run = small_table(spark, [(algorithm, dataset, list((settings or {}).items()), datetime.now(timezone.utc))], schema)
    for part, df in zip(_PARTS, (inds, tables.registry(), run)):
        stamped = df.withColumn("collection", F.lit(collection))
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(f"{folder}/{part}")


def read_collection(spark: SparkSession, folder: str, collection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, columns and run of a collection."""
    own = (spark.read.option("mergeSchema", "true").parquet(f"{folder}/{part}").where(F.col("collection") == collection) for part in _PARTS)
    return tuple(df.drop("collection") for df in own)


# --- measurements -------------------------------------------------------------------


def save_measurements(
    measurements: DataFrame, folder: str, run_id: str | None = None, algorithm: str = "discover", dataset: str = ""
) -> str:
    """Keeps the figures of a run under its id, beside those of other runs. Saved again, a run replaces itself."""
    run_id = run_id or str(uuid.uuid4())
    stamped = _stamped(measurements, algorithm, dataset, run_id)
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)
    return run_id


def read_measurements(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    """(run_id, algorithm, dataset, created_at, arity, phase, measure, value) of one run or of all."""
    # Ids are texts, also where they look like numbers; a partition's type would be guessed.
    figures = "algorithm string, dataset string, created_at timestamp, arity int, phase string, measure string, value double, run_id string"
    found = spark.read.schema(figures).parquet(folder).select("run_id", "algorithm", "dataset", "created_at", "arity", "phase", "measure", "value")
    return found if run_id is None else found.where(F.col("run_id") == run_id)


def level_writer(path: str, algorithm: str = "discover", dataset: str = "", run_id: str | None = None):
    """An ``on_level`` callback that appends each finished level, so that a later failure loses none."""
    run_id = run_id or str(uuid.uuid4())

    def write(level: DataFrame, arity: int) -> None:
        save(level.withColumn("arity", F.lit(arity)), path, None, algorithm, dataset, run_id)

    return write


def for_each(inds: DataFrame, callback: Callable[[Row], None]) -> None:
    """Streams rows through the driver one partition at a time."""
    for row in inds.toLocalIterator():
        callback(row)
