"""Dependency algebra. A dependency table has ``dep`` and ``ref`` as arrays of column ids;
position i pairs dep[i] with ref[i]. Canonical order: pairs ascending by (dep, ref)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Restrictions:
    """Which repetitions of columns an n-ary dependency may have.

    ``inter``: a column on both sides; ``intra``: a column twice on one side; ``trivial``:
    a pair of a column with itself may be embedded. A column is never paired with itself
    on the unary level, so ``trivial`` does not add level-wise results of its own.
    """

    inter: bool
    intra: bool
    trivial: bool


#: The selectable levels (fixed names and values).
RESTRICTIONS = {
    "NO_REPETITIONS": Restrictions(inter=False, intra=False, trivial=False),
    "NO_INTRA_REPETITIONS_NO_TRIVIAL": Restrictions(inter=True, intra=False, trivial=False),
    "NO_INTRA_REPETITIONS": Restrictions(inter=True, intra=False, trivial=True),
    "NO_TRIVIAL": Restrictions(inter=True, intra=True, trivial=False),
    "NO_INTER_REPETITIONS": Restrictions(inter=False, intra=True, trivial=False),
    "ANY_REPETITION": Restrictions(inter=True, intra=True, trivial=True),
}


def restrictions_of(name: str | Restrictions) -> Restrictions:
    if isinstance(name, Restrictions):
        return name
    if name not in RESTRICTIONS:
        raise ValueError(f"unknown restrictions {name!r}; choose from {sorted(RESTRICTIONS)}")
    return RESTRICTIONS[name]


# --- column expressions -------------------------------------------------------------


def pairs(dep: str | Column = "dep", ref: str | Column = "ref") -> Column:
    """The column pairs as array<struct<d, r>>."""
    return F.zip_with(dep, ref, lambda d, r: F.struct(d.alias("d"), r.alias("r")))


def arity(dep: str = "dep") -> Column:
    return F.size(dep)


def is_trivial(dep: str = "dep", ref: str = "ref") -> Column:
    return F.col(dep) == F.col(ref)


def is_implied_by(dep: Column, ref: Column, other_dep: Column, other_ref: Column) -> Column:
    """The first dependency is a projection of the other one."""
    return F.size(F.array_except(pairs(dep, ref), pairs(other_dep, other_ref))) == 0


def is_specializing(dep: Column, ref: Column, other_dep: Column, other_ref: Column) -> Column:
    """The first dependency properly contains the other one."""
    bigger = F.size(F.array_distinct(pairs(dep, ref))) > F.size(F.array_distinct(pairs(other_dep, other_ref)))
    return bigger & is_implied_by(other_dep, other_ref, dep, ref)


def is_disjoint(dep: Column, ref: Column, other_dep: Column, other_ref: Column) -> Column:
    """The two dependencies have no column pair in common."""
    return ~F.arrays_overlap(pairs(dep, ref), pairs(other_dep, other_ref))


def is_non_repeating(dep: str = "dep", ref: str = "ref", each_side: bool = True) -> Column:
    """No column occurs twice: on one side (``each_side``), or anywhere."""
    if each_side:
        return (F.size(F.array_distinct(dep)) == F.size(dep)) & (F.size(F.array_distinct(ref)) == F.size(ref))
    both = F.concat(dep, ref)
    return F.size(F.array_distinct(both)) == F.size(both)


def satisfies(restrictions: str | Restrictions, dep: str = "dep", ref: str = "ref") -> Column:
    rules = restrictions_of(restrictions)
    ok = F.lit(True)
    if not rules.intra:
        ok = ok & is_non_repeating(dep, ref)
    if not rules.inter:
        ok = ok & ~F.arrays_overlap(dep, ref)
    elif not rules.trivial:
        ok = ok & ~F.exists(F.zip_with(dep, ref, lambda d, r: d == r), lambda same: same)
    return ok


def canonical(df: DataFrame) -> DataFrame:
    """Pairs as a set, in canonical order."""
    z = F.array_sort(F.array_distinct(pairs()))
    return df.withColumn("_z", z).withColumn("dep", F.col("_z.d")).withColumn("ref", F.col("_z.r")).drop("_z")


def without_position(array: str | Column, position: Column) -> Column:
    a = F.col(array) if isinstance(array, str) else array
    return F.filter(a, lambda _, i: i != position)


# --- dependency tables --------------------------------------------------------------


def projections(df: DataFrame) -> DataFrame:
    """(…, position, p_dep, p_ref): every dependency with each of its single pairs."""
    return df.select("*", F.posexplode(pairs()).alias("position", "_p")).select(
        "*", F.array("_p.d").alias("p_dep"), F.array("_p.r").alias("p_ref")
    ).drop("_p")


def coprojections(df: DataFrame) -> DataFrame:
    """(…, position, c_dep, c_ref): every dependency with each pair left out once."""
    spread = df.select("*", F.explode(F.sequence(F.lit(0), F.size("dep") - 1)).alias("position"))
    return spread.select(
        "*",
        without_position("dep", F.col("position")).alias("c_dep"),
        without_position("ref", F.col("position")).alias("c_ref"),
    )


def implied(df: DataFrame, k: int) -> DataFrame:
    """(dep, ref): the distinct k-ary projections of the given dependencies, pair order kept."""
    if k < 1:
        raise ValueError("implied dependencies have at least one pair")
    one_arity = df.select("dep", "ref", F.size("dep").alias("_n")).where(F.col("_n") >= k)
    # Positions are chosen left to right, so that each choice is made once.
    chosen = one_arity.select("dep", "ref", F.array().cast("array<int>").alias("at"))
    for _ in range(k):
        next_position = F.sequence(F.coalesce(F.element_at("at", -1), F.lit(-1)) + 1, F.size("dep") - 1)
        chosen = chosen.where(F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(-1)) + 1 < F.size("dep")).select(
            "dep", "ref", "at",
            F.explode(
                F.when(F.size("at") == 0, F.sequence(F.lit(0), F.size("dep") - 1)).otherwise(next_position)
            ).alias("i"),
        ).select("dep", "ref", F.concat("at", F.array("i")).alias("at"))
    pick = lambda side: F.transform("at", lambda i: F.get(F.col(side), i))
    return chosen.select(pick("dep").alias("dep"), pick("ref").alias("ref")).distinct()


def consolidate(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing dependencies that are no direct projection of a new one."""
    covered = coprojections(new.select("dep", "ref")).select(F.col("c_dep").alias("dep"), F.col("c_ref").alias("ref"))
    return existing.join(covered, ["dep", "ref"], "left_anti")


def with_rarest_pair(df: DataFrame) -> DataFrame:
    """Adds ``_p``: of a dependency's pairs the one that fewest dependencies have."""
    spread = df.select("dep", "ref", F.explode(pairs()).alias("_p"))
    counts = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    rarest = spread.join(counts, "_p").groupBy("dep", "ref").agg(F.min(F.struct("_n", "_p"))["_p"].alias("_p"))
    return df.join(rarest, ["dep", "ref"])


def positive_border(df: DataFrame) -> DataFrame:
    """The maximal dependencies: none is a proper projection of another.

    A bigger dependency holds all pairs of a smaller one, in particular its rarest pair, so
    candidates meet in an equi-join on that pair and not on the whole subspace.
    """
    small = with_rarest_pair(df)
    big = df.select(F.col("dep").alias("_d"), F.col("ref").alias("_r"), F.explode(pairs()).alias("_p"))
    inside = is_specializing(F.col("_d"), F.col("_r"), F.col("dep"), F.col("ref"))
    return small.join(big, (small["_p"] == big["_p"]) & inside, "left_anti").drop("_p")


def negative_border(df: DataFrame) -> DataFrame:
    """The minimal ones among dependencies that do not hold."""
    small = with_rarest_pair(df).select(F.col("dep").alias("_d"), F.col("ref").alias("_r"), "_p")
    big = df.withColumn("_id", F.struct("dep", "ref")).withColumn("_p", F.explode(pairs()))
    inside = is_specializing(F.col("dep"), F.col("ref"), F.col("_d"), F.col("_r"))
    reducible = big.join(small, (big["_p"] == small["_p"]) & inside, "left_semi").select("_id").distinct()
    return df.join(reducible, F.struct("dep", "ref") == F.col("_id"), "left_anti")


def _covered(df: DataFrame, by: DataFrame) -> DataFrame:
    """(dep, ref): those of ``df`` whose pairs are all in, and not all of, one of ``by``."""
    small = with_rarest_pair(df)
    big = by.select(F.col("dep").alias("_d"), F.col("ref").alias("_r"), F.explode(pairs()).alias("_p"))
    inside = is_specializing(F.col("_d"), F.col("_r"), F.col("dep"), F.col("ref"))
    return small.join(big, (small["_p"] == big["_p"]) & inside, "left_semi").select("dep", "ref")


def extended_positive_border(border: DataFrame, new: DataFrame) -> DataFrame:
    """The maximal dependencies of a border and of what is new, without looking at what the border stands for.

    Equal to :func:`positive_border` of all that ever came: what left the border is covered
    by something that is still in it. What comes again changes nothing."""
    fresh = _without(new.select("dep", "ref").distinct(), border)
    top = positive_border(fresh)
    added = _without(top, _covered(top, border))
    return _without(border.select("dep", "ref"), _covered(border, top)).unionByName(added)


def extended_negative_border(border: DataFrame, new: DataFrame) -> DataFrame:
    """The minimal ones of a border and of what is new among dependencies that do not hold."""
    fresh = _without(new.select("dep", "ref").distinct(), border)
    bottom = negative_border(fresh).select("dep", "ref")
    added = _without(bottom, _covering(bottom, border))
    return _without(border.select("dep", "ref"), _covering(border, bottom)).unionByName(added)


def _covering(df: DataFrame, of: DataFrame) -> DataFrame:
    """(dep, ref): those of ``df`` that hold all pairs of one of ``of``, and more."""
    small = with_rarest_pair(of).select(F.col("dep").alias("_d"), F.col("ref").alias("_r"), "_p")
    big = df.select("dep", "ref").withColumn("_p", F.explode(pairs()))
    inside = is_specializing(F.col("dep"), F.col("ref"), F.col("_d"), F.col("_r"))
    return big.join(small, (big["_p"] == small["_p"]) & inside, "left_semi").select("dep", "ref").distinct()


def _without(df: DataFrame, gone: DataFrame) -> DataFrame:
    return df.join(gone.select("dep", "ref").distinct(), ["dep", "ref"], "left_anti")


def of_arity(df: DataFrame, k: int) -> DataFrame:
    return df.where(F.size("dep") == k)


def with_subspace(df: DataFrame, column_bits: int = 16) -> DataFrame:
    """Adds the (dependent table, referenced table) numbers."""
    return df.withColumn("dep_table", F.shiftright(F.element_at("dep", 1), column_bits)).withColumn(
        "ref_table", F.shiftright(F.element_at("ref", 1), column_bits)
    )


def by_subspace(df: DataFrame, column_bits: int = 16) -> DataFrame:
    """(dep_table, ref_table, arity, n): how many dependencies each subspace has."""
    return with_subspace(df, column_bits).groupBy("dep_table", "ref_table", F.size("dep").alias("arity")).agg(
        F.count(F.lit(1)).alias("n")
    )


def by_dependent(df: DataFrame, k: int) -> DataFrame:
    """(dep, refs): the k-ary dependencies collected per dependent side."""
    return of_arity(df, k).groupBy("dep").agg(F.sort_array(F.collect_list("ref")).alias("refs"))


def by_arity(df: DataFrame) -> DataFrame:
    """Sorted by arity, then dependent, then referenced columns."""
    return df.orderBy(F.size("dep"), "dep", "ref")


def lexicographic(df: DataFrame) -> DataFrame:
    """Sorted by dependent columns, shorter prefix first, then referenced columns."""
    return df.orderBy("dep", F.size("dep"), "ref")
