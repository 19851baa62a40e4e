"""Ids to names and to readable text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsumo.functions.words import string_array
from subsumo.sources.tables import TableSet

# Texts of the readable form (fixed values).
INCLUDED_IN = " ⊆ "
EMPTY_IND = "[] ⊆ []"
RULE_FORMAT = "〈%s〉 ⇉ 〈%s〉"
UNKNOWN_TABLE = "(unknown table with ID %d)"
COLUMN_OF_UNKNOWN_TABLE = "column%d"
UNKNOWN_COLUMN = "(unknown column with index %d)"


def _table_names(tables: TableSet) -> Column:
    return string_array([t.name for t in tables.tables])


def _column_names(tables: TableSet) -> Column:
    return F.from_json(F.lit(json.dumps([t.column_names for t in tables.tables])), "array<array<string>>")


def table_name(tables: TableSet, column_id: Column) -> Column:
    number = tables.table_number_of(column_id)
    unknown = F.format_string(UNKNOWN_TABLE, column_id.bitwiseOR(F.lit(tables.mask)))
    return F.coalesce(F.get(_table_names(tables), number), unknown)


def column_name(tables: TableSet, column_id: Column) -> Column:
    number, index = tables.table_number_of(column_id), column_id.bitwiseAND(F.lit(tables.mask))
    of_table = F.get(_column_names(tables), number)
    return F.when(of_table.isNull(), F.format_string(COLUMN_OF_UNKNOWN_TABLE, index)).otherwise(
        F.coalesce(F.get(of_table, index), F.format_string(UNKNOWN_COLUMN, index))
    )


def named(inds: DataFrame, tables: TableSet, dep: str = "dep", ref: str = "ref") -> DataFrame:
    """Adds (dep_names, ref_names) as arrays of (table, column); empty for 0-ary ones."""
    full = lambda c: F.struct(table_name(tables, c).alias("table"), column_name(tables, c).alias("column"))
    return inds.withColumn(f"{dep}_names", F.transform(dep, full)).withColumn(f"{ref}_names", F.transform(ref, full))


def _side(tables: TableSet, side: str | Column) -> Column:
    side = F.col(side) if isinstance(side, str) else side
    indices = F.array_join(F.transform(side, lambda c: c.bitwiseAND(F.lit(tables.mask)).cast("string")), ", ")
    return F.concat(table_name(tables, F.get(side, F.lit(0))), F.lit("["), indices, F.lit("]"))


def rendered(tables: TableSet, dep: str | Column = "dep", ref: str | Column = "ref") -> Column:
    """``file[0, 1] ⊆ file[2, 3]``"""
    text = F.concat(_side(tables, dep), F.lit(INCLUDED_IN), _side(tables, ref))
    return F.when(F.size(dep) == 0, F.lit(EMPTY_IND)).otherwise(text)


def rendered_partial(tables: TableSet, dep: str | Column, ref: str | Column, overlap: str = "overlap") -> Column:
    """The readable form followed by the relative overlap."""
    return F.concat(rendered(tables, dep, ref), F.lit(" (overlap="), F.col(overlap).cast("string"), F.lit(")"))


def rendered_rule(tables: TableSet) -> Column:
    return F.format_string(RULE_FORMAT, rendered(tables, "lhs_dep", "lhs_ref"), rendered(tables, "rhs_dep", "rhs_ref"))


def _named_ind(tables: TableSet, dep: str, ref: str) -> Column:
    join = lambda side: F.concat(
        F.lit("["),
        F.array_join(F.transform(side, lambda c: F.concat(table_name(tables, c), F.lit("."), column_name(tables, c))), ", "),
        F.lit("]"),
    )
    return F.concat(join(dep), F.lit(INCLUDED_IN), join(ref))


def rendered_named(inds: DataFrame, tables: TableSet) -> DataFrame:
    """Adds ``text``: ``[t.a, t.b] ⊆ [u.c, u.d]``, with names instead of positions."""
    return inds.withColumn("text", _named_ind(tables, "dep", "ref"))


def rendered_named_rules(rules: DataFrame, tables: TableSet) -> DataFrame:
    """Adds ``text``: a rule with names instead of positions."""
    sides = _named_ind(tables, "lhs_dep", "lhs_ref"), _named_ind(tables, "rhs_dep", "rhs_ref")
    return rules.withColumn("text", F.format_string(RULE_FORMAT, *sides))
