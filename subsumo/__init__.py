"""Inclusion-dependency discovery on Spark DataFrames.

    from subsumo import TableSet, discover

    tables = TableSet.from_dataframes(spark, {"orders": orders, "lineitem": lineitem})
    found = discover(tables, max_arity=3)
    found.maximal().show()
"""

from subsumo.plans.discovery import Discovery, DiscoveryError, discover
from subsumo.plans.rules import RuleDiscovery, discover_with_rules
from subsumo.operators.unary import (
    count_unary_inds,
    overlap_histogram,
    partial_unary_inds,
    unary_inds,
    unary_overlaps,
    void_unary_inds,
)
from subsumo.sources.csv import Dialect, csv_tables
from subsumo.sources.tables import TableSet

__all__ = [
    "Dialect",
    "Discovery",
    "DiscoveryError",
    "RuleDiscovery",
    "TableSet",
    "count_unary_inds",
    "csv_tables",
    "discover",
    "discover_with_rules",
    "overlap_histogram",
    "partial_unary_inds",
    "unary_inds",
    "unary_overlaps",
    "void_unary_inds",
]
