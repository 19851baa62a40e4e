"""Exact and partial dependencies between single columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsumo.functions.words import int_array, members
from subsumo.operators.cells import cells
from subsumo.operators.groups import attribute_groups, inclusions, member_sizes, member_stats, overlaps, values_only
from subsumo.sources.tables import TableSet

#: Buckets of relative overlap (fixed values).
OVERLAP_BUCKETS = ["[0, 0]", "[0, 0.1)", "[0.1, 0.9)", "[0.9, 0.99)", "[0.99, 1)", "[1.0, 1.0]"]

#: Least relative overlap of a partial dependency unless told otherwise (fixed value).
DEFAULT_MIN_OVERLAP = 0.9


def column_groups(tables: TableSet, drop_nulls: bool = True, count_nulls: bool = False) -> DataFrame:
    return attribute_groups(cells(tables, drop_nulls, count_nulls), ["k0"], len(tables.columns))


def attribute_group_lists(tables: TableSet, drop_nulls: bool = True) -> DataFrame:
    """(columns, n): every distinct attribute group as sorted column ids."""
    ids = int_array([c.column_id for c in tables.columns])
    return column_groups(tables, drop_nulls).select(
        F.transform(members("words"), lambda m: F.get(ids, m)).alias("columns"), "n"
    )


def column_sizes(tables: TableSet, drop_nulls: bool = True) -> DataFrame:
    """(column_id, size) of every column that has a value."""
    sizes = member_sizes(column_groups(tables, drop_nulls))
    return sizes.select(tables.column_id_of(F.col("m")).alias("column_id"), "size")


def column_null_stats(tables: TableSet, groups: DataFrame | None = None) -> DataFrame:
    """(column_id, size, nulls) of every column that has a row: values and nulls from one scan of each table."""
    stats = member_stats(column_groups(tables, count_nulls=True) if groups is None else groups)
    return stats.select(tables.column_id_of(F.col("m")).alias("column_id"), "size", "nulls")


def column_inclusions(tables: TableSet, drop_nulls: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """(dep, size, refs): per column with a value, its size and the columns that include it.

    ``groups`` takes :func:`column_groups` that are there already."""
    ids = int_array([c.column_id for c in tables.columns])
    return inclusions(column_groups(tables, drop_nulls) if groups is None else values_only(groups)).select(
        tables.column_id_of(F.col("m")).alias("dep"),
        "size",
        F.transform(F.array_remove(members("refs"), F.col("m")), lambda m: F.get(ids, m)).alias("refs"),
    )


def unary_inds(
    tables: TableSet, drop_nulls: bool = True, include_void: bool = True, found: DataFrame | None = None
) -> DataFrame:
    """(dep, ref, size): all column pairs with dep included in ref.

    Void columns have size 0 and are included in every other column. ``found`` takes
    :func:`column_inclusions` that are there already."""
    found = column_inclusions(tables, drop_nulls) if found is None else found
    if not include_void:
        return found.select("dep", F.explode("refs").alias("ref"), "size")
    every = tables.registry().select(F.col("column_id").alias("dep")).join(found, "dep", "left")
    return every.select(
        "dep",
        F.explode(F.coalesce("refs", _all_others(tables))).alias("ref"),
        F.coalesce("size", F.lit(0).cast("bigint")).alias("size"),
    )


def void_unary_inds(tables: TableSet, drop_nulls: bool = True) -> DataFrame:
    """(dep, ref, size): only those of columns without any value."""
    found = column_sizes(tables, drop_nulls).withColumnRenamed("column_id", "dep")
    void = tables.registry().select(F.col("column_id").alias("dep")).join(found, "dep", "left_anti")
    return void.select("dep", F.explode(_all_others(tables)).alias("ref"), F.lit(0).cast("bigint").alias("size"))


def _all_others(tables: TableSet) -> Column:
    return F.array_remove(int_array([c.column_id for c in tables.columns]), F.col("dep"))


def count_unary_inds(tables: TableSet, drop_nulls: bool = True) -> DataFrame:
    """(n): how many dependencies hold between columns that have values."""
    return column_inclusions(tables, drop_nulls).agg(
        F.coalesce(F.sum(F.size("refs").cast("bigint")), F.lit(0).cast("bigint")).alias("n")
    )


def unary_overlaps(tables: TableSet, drop_nulls: bool = True) -> DataFrame:
    """(dep, ref, size, overlap) for every ordered pair of columns that share a value."""
    return overlaps(column_groups(tables, drop_nulls)).select(
        tables.column_id_of(F.col("m")).alias("dep"), tables.column_id_of(F.col("ref")).alias("ref"), "size", "overlap"
    )


def partial_unary_inds(
    tables: TableSet, min_overlap: float = DEFAULT_MIN_OVERLAP, drop_nulls: bool = True, max_error: float | None = None
) -> DataFrame:
    """(dep, ref, dep_size, overlap): pairs whose shared part of dep reaches the threshold.

    Pairs without a shared value are never reported, not even at threshold 0."""
    if max_error is not None:
        min_overlap = 1.0 - max_error
    ratio = F.col("overlap").cast("double") / F.col("size")
    return (
        unary_overlaps(tables, drop_nulls)
        .select("dep", "ref", F.col("size").alias("dep_size"), ratio.alias("overlap"))
        .where(F.col("overlap") >= F.lit(float(min_overlap)))
    )


def overlap_histogram(tables: TableSet, drop_nulls: bool = True) -> DataFrame:
    """(bucket, n): column pairs by relative overlap. All buckets are listed."""
    ratio = F.col("overlap").cast("double") / F.col("size")
    counts = unary_overlaps(tables, drop_nulls).select(ratio.alias("r")).agg(
        F.count_if(F.col("r") < 0.1).alias("b1"),
        F.count_if((F.col("r") >= 0.1) & (F.col("r") < 0.9)).alias("b2"),
        F.count_if((F.col("r") >= 0.9) & (F.col("r") < 0.99)).alias("b3"),
        F.count_if((F.col("r") >= 0.99) & (F.col("r") < 1)).alias("b4"),
        F.count_if(F.col("r") >= 1).alias("b5"),
    )
    n_columns = len(tables.columns)
    zero = F.lit(n_columns * (n_columns - 1)).cast("bigint") - sum(F.col(f"b{i}") for i in range(1, 6))
    rows = [F.struct(F.lit(OVERLAP_BUCKETS[0]).alias("bucket"), zero.alias("n"))]
    rows += [F.struct(F.lit(OVERLAP_BUCKETS[i]).alias("bucket"), F.col(f"b{i}").alias("n")) for i in range(1, 6)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
