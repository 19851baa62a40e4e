"""Tables in long form: one row per (column, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsumo.functions.text import group_key, has_digest
from subsumo.functions.words import BITS
from subsumo.sources.tables import TableSet


def cells(tables: TableSet, drop_nulls: bool = True, count_nulls: bool = False) -> DataFrame:
    """(word, bit, k0) for every cell, with the column given by its bit slot.

    With ``count_nulls`` null cells are kept, without a bit and marked by their column in ``null_of``."""
    parts = [_table_cells(tables, t, drop_nulls, count_nulls) for t in tables.tables if t.width]
    return union_all(parts, tables.spark, "word int, bit bigint, k0 string" + ", null_of int" * count_nulls)


def _table_cells(tables: TableSet, table, drop_nulls: bool, count_nulls: bool) -> DataFrame:
    """A table's columns have consecutive members, so a cell's slot follows from its place in the row."""
    first = next(c.member for c in tables.columns if c.table_number == table.number)
    kept = table.key_columns is not None
    # The array stands in the generator itself: behind a name it would also be made for a filter on its size.
    texts = F.array(*[f"c{i}" for i in range(table.width)])
    cell = (tables.keys(table) if kept else table.text()).select(F.posexplode(texts).alias("at", "k0"))
    if drop_nulls and not count_nulls:
        cell = cell.where(F.col("k0").isNotNull())
    if not kept and any(map(has_digest, table.types)):
        # Once for all columns: texts of other types are never long.
        cell = cell.withColumn("k0", group_key(F.col("k0"), T.StringType(), tables.digest_long))
    member = F.col("at") + first
    bit = F.expr(f"shiftleft(1L, (at + {first}) % {BITS})")
    seen = F.col("k0").isNotNull()
    slots = [(member / BITS).cast("int").alias("word"), (F.when(seen, bit).otherwise(F.lit(0)) if count_nulls else bit).alias("bit")]
    return cell.select(*slots, "k0", *[F.when(~seen, member).alias("null_of")] * count_nulls)


def cell_values(tables: TableSet, drop_nulls: bool = True) -> DataFrame:
    """(column_id, v): the cells with plain values, for inspection and export."""
    parts = []
    for table in (t for t in tables.tables if t.width):
        entries = [
            F.struct(F.lit(c.column_id).alias("column_id"), F.col(f"c{c.index}").alias("v"))
            for c in tables.columns
            if c.table_number == table.number
        ]
        part = table.text().select(F.inline(F.array(*entries)))
        parts.append(part.where(F.col("v").isNotNull()) if drop_nulls else part)
    return union_all(parts, tables.spark, "column_id int, v string")


def tuples(tables: TableSet) -> DataFrame:
    """(table_id, f): the rows of all tables as arrays of text."""
    parts = [t.tuples().select(F.lit(tables.table_id(t.number)).alias("table_id"), "f") for t in tables.tables if t.width]
    return union_all(parts, tables.spark, "table_id int, f array<string>")


def union_all(parts: list[DataFrame], spark: SparkSession | None = None, schema: str | None = None) -> DataFrame:
    """All rows; without parts an empty table of the given schema."""
    if not parts and schema:
        return (spark or SparkSession.getActiveSession()).createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)
