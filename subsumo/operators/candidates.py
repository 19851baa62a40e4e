"""Candidate generation for the next arity, inside each (dependent, referenced) subspace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from subsumo.operators.algebra import Restrictions, coprojections, is_trivial, restrictions_of, with_subspace

#: (dependencies of the last level, unary dependencies, next arity, restrictions, column bits) -> candidates
Generator = Callable[[DataFrame, DataFrame, int, Restrictions, int], DataFrame]


#: Parts that the left side of a pairing is dealt to, as one subspace may hold most dependencies.
_SALTS = 16


def _last(side: str) -> Column:
    return F.element_at(side, -1)


def _dealt(df: DataFrame) -> DataFrame:
    """Every row in one part."""
    return df.withColumn("part", F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)))


def _repeated(df: DataFrame) -> DataFrame:
    """Every row in all parts."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<bigint>")))


def apriori_candidates(
    last: DataFrame, unary: DataFrame | None, arity: int, restrictions: str | Restrictions = "NO_REPETITIONS",
    column_bits: int = 16,
) -> DataFrame:
    """(dep, ref): two dependencies with the same prefix are merged; the candidate stays if
    all its direct projections are known."""
    rules = restrictions_of(restrictions)
    known = with_subspace(last.select("dep", "ref"), column_bits)
    prefix = lambda side: F.slice(side, 1, arity - 2)
    keyed = known.select(
        "dep_table", "ref_table", prefix("dep").alias("pd"), prefix("ref").alias("pr"),
        _last("dep").alias("d"), _last("ref").alias("r"),
    )
    left = _dealt(keyed.withColumnsRenamed({"d": "d1", "r": "r1"}))
    right = _repeated(keyed.withColumnsRenamed({"d": "d2", "r": "r2"}))
    if rules.intra:
        ordered = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("r1") < F.col("r2")))
    else:
        ordered = (F.col("d1") < F.col("d2")) & (F.col("r1") != F.col("r2"))
    fine = ordered if rules.inter else ordered & (F.col("d1") != F.col("r2")) & (F.col("d2") != F.col("r1"))
    merged = (
        left.join(right, ["dep_table", "ref_table", "pd", "pr", "part"])
        .where(fine)
        .select(F.concat("pd", F.array("d1", "d2")).alias("dep"), F.concat("pr", F.array("r1", "r2")).alias("ref"))
    )
    if arity < 3:
        return merged
    # Leaving out one of the two last pairs gives back the merged dependencies themselves.
    to_check = coprojections(merged).where(F.col("position") < arity - 2)
    if rules.trivial:
        to_check = to_check.withColumn("excused", is_trivial("c_dep", "c_ref"))
    else:
        to_check = to_check.withColumn("excused", F.lit(False))
    seen = last.select(F.col("dep").alias("c_dep"), F.col("ref").alias("c_ref"), F.lit(True).alias("known"))
    return (
        to_check.join(seen, ["c_dep", "c_ref"], "left" if rules.trivial else "left_semi")
        .where(F.col("known") | F.col("excused") if rules.trivial else F.lit(True))
        .groupBy("dep", "ref")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == arity - 2)
        .select("dep", "ref")
    )


def binder_candidates(
    last: DataFrame, unary: DataFrame, arity: int, restrictions: str | Restrictions = "NO_REPETITIONS",
    column_bits: int = 16,
) -> DataFrame:
    """(dep, ref): a dependency is extended by every unary one with a later dependent column.
    Projections are not checked."""
    rules = restrictions_of(restrictions)
    if rules.inter or rules.intra or rules.trivial:
        raise ValueError("the binder generator supports NO_REPETITIONS only")
    left = _dealt(with_subspace(last.select("dep", "ref"), column_bits))
    right = with_subspace(unary.select("dep", "ref"), column_bits).select(
        "dep_table", "ref_table", F.element_at("dep", 1).alias("d"), F.element_at("ref", 1).alias("r")
    )
    return (
        left.join(_repeated(right), ["dep_table", "ref_table", "part"])
        .where(F.col("d") > _last("dep"))
        .where(~F.array_contains("ref", F.col("r")))
        .where(~F.array_contains("dep", F.col("r")) & ~F.array_contains("ref", F.col("d")))
        .select(F.concat("dep", F.array("d")).alias("dep"), F.concat("ref", F.array("r")).alias("ref"))
    )


def without_void(inds: DataFrame) -> DataFrame:
    """Keeps dependencies whose dependent side has a value (``size`` > 0)."""
    return inds.where(F.col("size") > 0)


#: name -> (generator, leaves void columns out of generation, removes projections of new results)
GENERATORS: dict[str, tuple[Generator, bool, bool]] = {
    "apriori": (apriori_candidates, False, True),
    "mind": (apriori_candidates, False, True),
    "apriori-no-void": (apriori_candidates, True, True),
    "mind-no-void": (apriori_candidates, True, True),
    "binder": (binder_candidates, True, False),
}


def generator_of(name: str | Generator) -> tuple[Generator, bool, bool]:
    if callable(name):
        # A generator of one's own says by its attributes how it wants to be run.
        return name, getattr(name, "excludes_void", False), getattr(name, "consolidates", True)
    if name not in GENERATORS:
        raise ValueError(f"unknown candidate generator {name!r}; choose from {sorted(GENERATORS)}")
    return GENERATORS[name]


# --- numbering ----------------------------------------------------------------------

_CLUSTERS, _PARTS = 256, 64


def with_dense_number(df: DataFrame, keys: list[str], name: str, near: list[str] | None = None) -> DataFrame:
    """Numbers distinct rows 0, 1, 2, … without sorting them in one task.

    Rows are numbered inside hash buckets; the bucket offsets are a running sum over the
    fixed number of buckets. Rows that agree in ``near`` get numbers close to each other,
    and even if they are most of the rows, they are dealt to many buckets."""
    cluster = F.pmod(F.xxhash64(*near), F.lit(_CLUSTERS)) if near else F.lit(0).cast("bigint")
    bucketed = df.withColumn("_b", cluster * _PARTS + F.pmod(F.xxhash64(*keys), F.lit(_PARTS)))
    counts = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_b", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_b")) - F.col("_n")).alias("_offset")
    )
    numbered = bucketed.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1)
    # At most _CLUSTERS * _PARTS offsets.
    return numbered.join(F.broadcast(offsets), "_b").withColumn(name, F.col("_rn") + F.col("_offset")).drop(
        "_b", "_rn", "_offset"
    )


def combos(candidates: DataFrame, column_bits: int = 16) -> DataFrame:
    """(combo_id, table, cols): all distinct sides of the candidates with a dense id."""
    sides = candidates.select(F.explode(F.array("dep", "ref")).alias("cols")).distinct()
    tagged = sides.withColumn("table", F.shiftright(F.element_at("cols", 1), column_bits))
    return with_dense_number(tagged, ["cols"], "combo_id", near=["table"]).select("combo_id", "table", "cols")


def with_chunk(candidates: DataFrame, chunk_size: int, column_bits: int = 16) -> DataFrame:
    """Adds a chunk number; a chunk has at most ``chunk_size`` candidates.

    Candidates of a subspace stay together, so that a chunk's job reads few tables and
    shares their combos."""
    placed = with_subspace(candidates.select("dep", "ref"), column_bits)
    numbered = with_dense_number(placed, ["dep", "ref"], "_number", near=["dep_table", "ref_table"])
    return numbered.select("dep", "ref", F.floor(F.col("_number") / chunk_size).alias("chunk"))


def restrict_combos(all_combos: DataFrame, candidates: DataFrame) -> DataFrame:
    """Only the combos that the given candidates use."""
    used = candidates.select(F.explode(F.array("dep", "ref")).alias("cols"))
    return all_combos.join(used, "cols", "left_semi")
