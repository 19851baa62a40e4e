"""Discovery with augmentation rules.

A rule ``lhs => rhs`` says: where dependency lhs holds, the unary dependency rhs may be
appended. Dependencies that rules can restore leave the result and the search.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from subsumo.operators.algebra import coprojections, restrictions_of
from subsumo.operators.candidates import Generator, generator_of
from subsumo.operators.cells import union_all
from subsumo.operators.lineup import lined_up
from subsumo.operators.nary import (
    check_candidates,
    chunk_combos,
    combo_groups,
    not_refuted,
    side_by_side,
)
from subsumo.operators.groups import inclusions, member_stats, values_only
from subsumo.operators.unary import column_groups, column_inclusions, column_null_stats, unary_inds
from subsumo.plans.discovery import (
    Discovery,
    DiscoveryError,
    LevelStats,
    Phases,
    as_ind_table,
    candidate_chunks,
    expects_failures,
    finish_level,
    lines_up,
)
from subsumo.session import counted, materialize, new_folder, small_table
from subsumo.sources.tables import TableSet


@dataclass
class RuleDiscovery(Discovery):
    """``levels`` without the dependencies that a rule restores, plus the rules."""

    rule_levels: list[DataFrame] = field(default_factory=list)

    def rules(self) -> DataFrame:
        """(lhs_dep, lhs_ref, rhs_dep, rhs_ref); lhs sides are empty in 0-ary rules."""
        schema = ", ".join(f"{c} array<int>" for c in ("lhs_dep", "lhs_ref", "rhs_dep", "rhs_ref"))
        return union_all(self.rule_levels, self.tables.spark, schema)


def discover_with_rules(
    tables: TableSet,
    max_arity: int = -1,
    generator: str | Generator = "apriori",
    restrictions: str = "NO_REPETITIONS",
    chunk_size: int = -1,
    drop_nulls: bool = True,
    refute: bool | None = None,
    on_ind: Callable[[Row], None] | None = None,
    on_level: Callable[[DataFrame, int], None] | None = None,
    line_up: bool | None = None,
) -> RuleDiscovery:
    """Like ``discover``, with rules. Void columns become rules, so they never generate."""
    generate, _, consolidates = generator_of(generator)
    allowed = restrictions_of(restrictions)
    found = RuleDiscovery(tables, consolidates)
    arity = 1
    try:
        started = time.perf_counter()
        # Values and nulls of one scan; all that follows comes from the written groups.
        groups = materialize(column_groups(tables, drop_nulls, count_nulls=drop_nulls))
        columns = materialize(column_inclusions(tables, drop_nulls, groups))
        stats = unary_combo_stats(columns, column_null_stats(tables, groups) if drop_nulls else None)
        unary = unary_with_ref_sizes(tables, columns)
        zero_ary = zero_ary_rules(unary)
        kept = counted(as_ind_table(unary.where(~is_zero_ary()).select("dep", "ref", "size")))
        _finish(found, kept, zero_ary, 1, len(tables.columns) * (len(tables.columns) - 1), started, on_ind, on_level)
        last = unary_kept = kept[0]
        while found.level_stats[-1].inds and (max_arity == -1 or arity < max_arity):
            arity += 1
            started = time.perf_counter()
            holding, current = None, None
            ind_folder, stat_folder = (new_folder(tables.spark, f"{kind}-{arity}") for kind in ("holding", "counted"))
            candidates = counted(generate(last, unary_kept, arity, allowed, tables.column_bits).select("dep", "ref"))
            phases = Phases(time.perf_counter() - started)
            if arity == 2 and candidates[1] and lines_up(tables, line_up):
                tables = lined_up(tables, candidates[0])
            for chunk in candidate_chunks(candidates, chunk_size, tables.column_bits):
                # Rules are read off valid dependencies, so counts of refuted ones are not needed.
                refutes = expects_failures(found, refute)
                left = not_refuted(tables, chunk, drop_nulls) if refutes else chunk
                phases.scans += refutes
                if not left:
                    continue
                combos = side_by_side(tables, chunk_combos(left))
                groups = materialize(combo_groups(tables, combos, drop_nulls, drop_nulls, left))
                results = check_candidates(tables, left, inclusions(values_only(groups)), combos).where("holds")
                holding = materialize(results.select("dep", "ref", "size"), ind_folder)
                current = materialize(combo_stats(tables, combos, groups), stat_folder)
                phases.scans += 1
            phases.validation = time.perf_counter() - started - phases.generation
            if holding is None:
                if candidates[1]:
                    found.level_stats.append(LevelStats(arity, candidates[1], 0, 0, time.perf_counter() - started))
                break
            # A combo can be in several chunks, each of which counts it whole.
            current = current.distinct()
            judged = materialize(judge(holding, current, stats))
            kept = counted(judged.where(~F.exists("is_rule", lambda r: r)).select("dep", "ref", "size"))
            last, stats = kept[0], current
            _finish(found, kept, nary_rules(judged), arity, candidates[1], started, on_ind, on_level, phases)
    except Exception as error:
        raise DiscoveryError(f"discovery failed at arity {arity}: {error}", found) from error
    return found


def _finish(found, kept, rules, arity, n_candidates, started, on_ind, on_level, phases=None) -> None:
    level, n = kept
    rules, n_rules = counted(rules)
    found.rule_levels.append(rules)
    finish_level(found, level, arity, n_candidates, n, started, on_ind, on_level, n_rules=n_rules, phases=phases)


# --- arity 0 ------------------------------------------------------------------------


def unary_with_ref_sizes(tables: TableSet, columns: DataFrame) -> DataFrame:
    """(dep, ref, size, ref_size) of all unary dependencies, void ones included."""
    everything = unary_inds(tables, found=columns)
    sizes = columns.select(F.col("dep").alias("ref"), F.col("size").alias("ref_size"))
    return everything.join(sizes, "ref", "left").select(
        "dep", "ref", "size", F.coalesce("ref_size", F.lit(0).cast("bigint")).alias("ref_size")
    )


def is_zero_ary():
    """No condition is needed if nothing is to be included, or in a single value."""
    return (F.col("size") == 0) | (F.col("ref_size") == 1)


def zero_ary_rules(unary: DataFrame) -> DataFrame:
    nothing = F.array().cast("array<int>")
    return unary.where(is_zero_ary()).select(
        nothing.alias("lhs_dep"), nothing.alias("lhs_ref"), F.array("dep").alias("rhs_dep"), F.array("ref").alias("rhs_ref")
    )


# --- higher arities -----------------------------------------------------------------


def unary_combo_stats(columns: DataFrame, stats: DataFrame | None) -> DataFrame:
    """(cols, size, nulls) per single column that has a value."""
    if stats is None:
        return columns.select(F.array("dep").alias("cols"), "size", F.lit(0).cast("bigint").alias("nulls"))
    return stats.where(F.col("size") > 0).select(F.array("column_id").alias("cols"), "size", "nulls")


def combo_stats(tables: TableSet, combos, groups: DataFrame) -> DataFrame:
    """(cols, size, nulls) per combo of a chunk. The key is sorted: order does not change counts."""
    schema = pa.schema([("m", pa.int32()), ("cols", pa.list_(pa.int32()))])
    listed = small_table(tables.spark, [(m, sorted(combo)) for m, combo in enumerate(combos)], schema).coalesce(1)
    zero = F.lit(0).cast("bigint")
    if "null_of" not in groups.columns:
        groups = groups.withColumns({"null_of": F.lit(None).cast("int"), "nulls": zero})
    stats = listed.join(member_stats(groups), "m", "left")
    return stats.select("cols", F.coalesce("size", zero).alias("size"), F.coalesce("nulls", zero).alias("nulls"))


def judge(inds: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """(dep, ref, size, is_rule): per dependency and position whether that pair follows.

    A pair follows if leaving it out of the referenced side changes neither the distinct
    values nor the null counts, or if the dependent side is void."""
    whole = current.select(F.col("cols").alias("whole"), F.col("size").alias("w_size"), F.col("nulls").alias("w_nulls"))
    part = previous.select(F.col("cols").alias("part"), F.col("size").alias("p_size"), F.col("nulls").alias("p_nulls"))
    spread = coprojections(inds).select(
        "dep", "ref", "size", "position", F.array_sort("ref").alias("whole"), F.array_sort("c_ref").alias("part")
    )
    follows = (F.col("size") == 0) | ((F.col("w_size") == F.col("p_size")) & (F.col("w_nulls") == F.col("p_nulls")))
    return (
        spread.join(whole, "whole", "left")
        .join(part, "part", "left")
        .groupBy("dep", "ref", "size")
        .agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce(follows, F.lit(False)).alias("is_rule")))).alias("p"))
        .select("dep", "ref", "size", F.col("p.is_rule").alias("is_rule"))
    )


def nary_rules(judged: DataFrame) -> DataFrame:
    spread = coprojections(judged).where(F.get("is_rule", F.col("position")))
    return spread.select(
        F.col("c_dep").alias("lhs_dep"),
        F.col("c_ref").alias("lhs_ref"),
        F.array(F.get("dep", F.col("position"))).alias("rhs_dep"),
        F.array(F.get("ref", F.col("position"))).alias("rhs_ref"),
    )
