"""The shared kernel: attribute groups and what follows from them.

A *member* is a column (unary) or a column combination (n-ary). The members that share a
value form its attribute group. Equal groups are merged with a count before anything is
expanded: the number of distinct groups depends on the schema, not on the rows, so every
step after the value shuffle works on small data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsumo.functions.words import BITS, members

#: Up to this many words are kept as one aggregate column each, in a single value shuffle.
MAX_DENSE_WORDS = 32


def attribute_groups(keyed: DataFrame, keys: Sequence[str], n_members: int) -> DataFrame:
    """(words, n): the distinct attribute groups and how many values have each. If there are
    few words, they are also given as columns w0, w1, …

    ``keyed`` has one row (word, bit, *keys) per occurrence of a value. A value that fills
    a third of all rows is one partial row per map task, since ``bit_or`` combines there.

    If it also has ``null_of``, rows in which that is a member stand for occurrences without a
    value, for ``times`` of them if there is such a column; all their keys are null. They become rows without words, with ``null_of`` and their
    number ``nulls``, one for each member and map task."""
    n_words = max(1, -(-n_members // BITS))
    nulls = ["null_of"] if "null_of" in keyed.columns else []
    times = F.col("times") if "times" in keyed.columns else F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    rows = [F.sum(F.when(F.col("null_of").isNotNull(), times).otherwise(none)).alias("nulls")] if nulls else []
    summed = [F.sum("nulls").alias("nulls")] if nulls else []
    if n_words <= MAX_DENSE_WORDS:
        names = [f"w{k}" for k in range(n_words)]
        if n_words == 1:
            merged = [F.bit_or("bit").alias("w0")]
        else:
            merged = [
                F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("bigint")).alias(name)
                for k, name in enumerate(names)
            ]
        per_value = keyed.groupBy(*keys, *nulls).agg(*merged, *rows)
        counted = per_value.groupBy(*names, *nulls).agg(F.count(F.lit(1)).alias("n"), *summed)
        return counted.withColumn("words", _sparse(names))
    # Very wide schemas: one word per row first, so that no row carries all words.
    per_word = keyed.groupBy(*keys, *nulls, "word").agg(F.bit_or("bit").alias("bits"), *rows)
    some = F.when(F.col("bits") != 0, F.struct(F.col("word").alias("k"), "bits"))
    per_value = per_word.groupBy(*keys, *nulls).agg(F.sort_array(F.collect_list(some)).alias("words"), *summed)
    return per_value.groupBy("words", *nulls).agg(F.count(F.lit(1)).alias("n"), *summed)


def values_only(groups: DataFrame) -> DataFrame:
    """The groups of values, without the rows that count nulls."""
    return groups.where(F.col("null_of").isNull()).drop("null_of", "nulls") if "null_of" in groups.columns else groups


def member_stats(groups: DataFrame) -> DataFrame:
    """(m, size, nulls): distinct values and nulls per member, from one reading of groups with null counts."""
    entry = lambda m, size, nulls: F.struct(m.alias("m"), size.alias("size"), nulls.alias("nulls"))
    zero = F.lit(0).cast("bigint")
    entries = F.when(F.col("null_of").isNotNull(), F.array(entry(F.col("null_of"), zero, F.col("nulls")))).otherwise(
        F.transform(members("words"), lambda m: entry(m, F.col("n"), zero))
    )
    return groups.select(F.inline(entries)).groupBy("m").agg(F.sum("size").alias("size"), F.sum("nulls").alias("nulls"))


def _sparse(names: Sequence[str]) -> Column:
    """Columns with one word each as a word array."""
    slots = [F.struct(F.lit(k).alias("k"), F.col(name).alias("bits")) for k, name in enumerate(names)]
    return F.filter(F.array(*slots), lambda w: w.bits != 0)


def member_sizes(groups: DataFrame) -> DataFrame:
    """(m, size): distinct values per member."""
    return groups.select(F.explode(members("words")).alias("m"), "n").groupBy("m").agg(F.sum("n").alias("size"))


def inclusions(groups: DataFrame) -> DataFrame:
    """(m, size, refs): per member its distinct values and the members that hold all of them.

    ``refs`` is a word array that contains the member itself. Groups are first merged by pairs
    of words: what the members of one word have in common with another word is the same for
    all groups that agree in both. Only then are a word's at most 63 members expanded, each
    with one other word, whatever the width of the schema is."""
    pairs = (
        groups.select(F.explode("words").alias("own"), "words", "n")
        .select("own", F.explode("words").alias("other"), "n")
        .groupBy("own", "other")
        .agg(F.sum("n").alias("n"))
    )
    common = (
        pairs.select(F.explode(members("array(own)")).alias("m"), "own", "other", "n")
        .groupBy("m", F.col("own.k").alias("own"), F.col("other.k").alias("k"))
        .agg(F.bit_and("other.bits").alias("bits"), F.sum("n").alias("s"))
    )
    # A word is common to all values of a member only if no value lacks it.
    return (
        common.groupBy("m")
        .agg(F.max(F.when(F.col("k") == F.col("own"), F.col("s"))).alias("size"), F.sort_array(F.collect_list(F.struct("k", "bits", "s"))).alias("ws"))
        .select(
            "m",
            "size",
            F.expr("transform(filter(ws, w -> w.s = size and w.bits != 0), w -> struct(w.k as k, w.bits as bits))").alias("refs"),
        )
    )


def overlaps(groups: DataFrame) -> DataFrame:
    """(m, size, ref, overlap): shared distinct values of every overlapping ordered pair.

    Pairs are not expanded per group. Groups are first merged per member and word pattern,
    then each merged row yields the at most 63 members of its word. A member's overlap with
    itself is its size, so the groups are read once."""
    patterns = (
        groups.select(F.explode(members("words")).alias("m"), "words", "n")
        .select("m", "n", F.explode("words").alias("w"))
        .groupBy("m", F.col("w.k").alias("k"), F.col("w.bits").alias("bits"))
        .agg(F.sum("n").alias("n"))
        .select("m", "n", F.array(F.struct("k", "bits")).alias("word"))
    )
    shared = (
        patterns.select("m", "n", F.explode(members("word")).alias("ref"))
        .groupBy("m", "ref")
        .agg(F.sum("n").alias("overlap"))
    )
    return (
        shared.groupBy("m")
        .agg(
            F.max(F.when(F.col("m") == F.col("ref"), F.col("overlap"))).alias("size"),
            F.collect_list(F.struct("ref", "overlap")).alias("all"),
        )
        .select("m", "size", F.inline("all"))
        .where(F.col("m") != F.col("ref"))
    )


def inclusion_lists(groups: DataFrame) -> DataFrame:
    """(dep, refs, n): evidence of each distinct group for each of its members."""
    return groups.select(members("words").alias("g"), "n").select(F.explode("g").alias("dep"), "g", "n").select(
        "dep", F.array_remove("g", F.col("dep")).alias("refs"), "n"
    )
