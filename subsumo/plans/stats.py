"""What a table set holds: rows, columns, nulls and distinct values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsumo.operators.cells import union_all
from subsumo.operators.unary import column_null_stats, column_sizes
from subsumo.session import small_table
from subsumo.sources.tables import TableSet


def table_stats(tables: TableSet) -> DataFrame:
    """(table_name, width, height) per table. Rows are only counted, those of all tables in one aggregation."""
    schema = pa.schema([("number", pa.int32()), ("table_name", pa.string()), ("width", pa.int64())])
    known = small_table(tables.spark, [(t.number, t.name, t.width) for t in tables.tables], schema)
    rows = union_all([t.df.select(F.lit(t.number).alias("number")) for t in tables.tables], tables.spark, "number int")
    counts = rows.groupBy("number").agg(F.count(F.lit(1)).alias("height"))
    height = F.coalesce("height", F.lit(0).cast("bigint")).alias("height")
    return known.join(counts, "number", "left").select("table_name", "width", height)


def dataset_stats(tables: TableSet) -> DataFrame:
    """(columns, tuples) of the whole set."""
    return table_stats(tables).agg(F.sum("width").alias("columns"), F.sum("height").alias("tuples"))


def column_stats(tables: TableSet, drop_nulls: bool = True) -> DataFrame:
    """(table_name, name, column_id, size, nulls) per column.

    When nulls are kept they are values, so they count as one in ``size`` and not as nulls."""
    zero = F.lit(0).cast("bigint")
    found = column_null_stats(tables) if drop_nulls else column_sizes(tables, False).withColumn("nulls", zero)
    return tables.registry().join(found, "column_id", "left").select(
        "table_name", "name", "column_id", F.coalesce("size", zero).alias("size"), F.coalesce("nulls", zero).alias("nulls")
    )
