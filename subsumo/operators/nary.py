"""Validation of n-ary candidates, one bounded chunk at a time."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsumo.functions.words import BITS, contains, slot
from subsumo.operators.cells import union_all
from subsumo.operators.groups import attribute_groups, inclusions
from subsumo.session import small_table
from subsumo.sources.tables import Table, TableSet

Combo = tuple[int, ...]


def combo_values(
    tables: TableSet,
    combos: Sequence[Combo],
    drop_nulls: bool = True,
    count_nulls: bool = False,
    only: Sequence[int] | None = None,
) -> DataFrame:
    """(word, bit, k0, k1, …): per row and requested combo the values of its columns.

    Only tables and columns that occur in a combo are scanned, and lineups in place of tables
    where they have all columns of a combo: combos of several tables with the same columns of a
    lineup are then one row, with the bits of all of them. Values stay separate key
    columns, so no separator can be confused with data. With ``drop_nulls`` a combo with
    any null is left out; with ``count_nulls`` it is kept without bit and values, marked
    by its number in ``null_of``, and ``times`` says for how many rows it stands. ``only`` takes
    the positions of combos to which the rows are limited."""
    n = len(combos[0])
    keys = [f"k{i}" for i in range(n)]
    places = [F.get("f", F.col(f"i{i}")).alias(key) for i, key in enumerate(keys)]
    shared, rest = _sources(tables, combos, range(len(combos)) if only is None else only)
    parts = []

    def add(part: DataFrame, whole: bool = False) -> None:
        """``whole``: no value is null."""
        if count_nulls and whole:
            part = part.withColumn("null_of", F.lit(None).cast("int"))
        elif count_nulls:
            missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
            part = part.withColumn("null_of", F.when(missing, F.col("m")))
            seen = F.col("null_of").isNull()
            part = part.withColumns({"bit": F.when(seen, F.col("bit")).otherwise(F.lit(0)), **{k: F.when(seen, F.col(k)) for k in keys}})
        elif drop_nulls and not whole:
            part = part.dropna(how="any", subset=keys)
        times = ["times", "null_of"] if count_nulls else []
        parts.append(part.select("word", "bit", *keys, *times))

    for number, by_slots in shared.items():
        lineup = tables.lineups[number]
        rows = [f"n{at}" for at in range(len(lineup.tables))]
        values = lineup.df.select(F.array(*[f"s{i}" for i in range(len(set(lineup.slots.values())))]).alias("f"), *rows)
        if count_nulls and lineup.has_nulls:
            # Nulls are counted by table, so each combo has a row of its own.
            entries = [
                {"word": slot(m)[0], "bit": slot(m)[1], "m": m, "at": at, **_places(slots)}
                for slots, by_table in by_slots.items()
                for at, m in by_table.items()
            ]
            times = F.get(F.array(*rows), F.col("at"))
            each = values.select("f", *rows, _literal(entries, "word int, bit bigint, m int, at int", n))
            add(each.select("word", "bit", "m", times.alias("times"), *places).where(F.col("times") > 0))
        else:
            bits = [f"b{at}" for at in range(len(rows))]
            entries = [
                {"word": word, **{b: _bit_in(word, by_table.get(at)) for at, b in enumerate(bits)}, **_places(slots)}
                for slots, by_table in by_slots.items()
                for word in sorted({slot(m)[0] for m in by_table.values()})
            ]
            each = values.select("f", *rows, _literal(entries, "word int, " + ", ".join(f"{b} bigint" for b in bits), n))
            bit = reduce(
                lambda a, b: a.bitwiseOR(b),
                [F.when(F.col(row) > 0, F.col(b)).otherwise(F.lit(0).cast("bigint")) for row, b in zip(rows, bits)],
            )
            part = each.select("word", bit.alias("bit"), F.lit(1).cast("bigint").alias("times"), *places).where(F.col("bit") != 0)
            add(part, not lineup.has_nulls)
    for table, needed, entries in _per_table(tables, [(m, combos[m]) for m in rest]):
        add(
            tables.keys(table, needed)
            .select(F.array(*[f"c{i}" for i in needed]).alias("f"))
            .select("f", _literal(entries, "word int, bit bigint, m int", n))
            .select("word", "bit", "m", F.lit(1).cast("bigint").alias("times"), *places)
        )
    return union_all(parts)


def _bit_in(word: int, member: int | None) -> int:
    return slot(member)[1] if member is not None and slot(member)[0] == word else 0


def _places(at: Sequence[int]) -> dict[str, int]:
    return {f"i{i}": place for i, place in enumerate(at)}


def _sources(
    tables: TableSet, combos: Sequence[Combo], members: Iterable[int]
) -> tuple[dict[int, dict[Combo, dict[int, int]]], list[int]]:
    """({lineup: {slots: {place of the table: member}}}, members that are read from their table)"""
    shared, rest = defaultdict(lambda: defaultdict(dict)), []
    for member in members:
        for number, lineup in enumerate(tables.lineups):
            if place := lineup.place(combos[member], tables.column_bits):
                shared[number][place[1]][place[0]] = member
                break
        else:
            rest.append(member)
    return shared, rest


def _per_table(tables: TableSet, combos: Sequence[tuple[int, Combo]]) -> Iterator[tuple[Table, list[int], list[dict]]]:
    """(table, needed column indices, entries: slot, member and places of its columns among the needed ones)"""
    grouped = defaultdict(list)
    for member, combo in combos:
        grouped[combo[0] >> tables.column_bits].append((member, [c & tables.mask for c in combo]))
    for table in tables.tables:
        if table.number in grouped:
            needed = sorted({i for _, indices in grouped[table.number] for i in indices})
            place = {index: at for at, index in enumerate(needed)}
            entries = [
                {"word": slot(m)[0], "bit": slot(m)[1], "m": m, **_places([place[i] for i in ix])} for m, ix in grouped[table.number]
            ]
            yield table, needed, entries


def _literal(entries: list[dict], fields: str, n: int) -> Column:
    """Repeats every row for each entry, whose fields and places i0, i1, … become columns."""
    places = ", ".join(f"i{i} int" for i in range(n))
    struct = ", ".join(f"{x.split()[0]}:{x.split()[1]}" for x in f"{fields}, {places}".split(", "))
    return F.inline(F.from_json(F.lit(json.dumps(entries)), f"array<struct<{struct}>>"))


def combo_groups(
    tables: TableSet,
    combos: Sequence[Combo],
    drop_nulls: bool = True,
    count_nulls: bool = False,
    candidates: Sequence[tuple[Combo, Combo]] | None = None,
) -> DataFrame:
    """Attribute groups with the positions of combos in the given list as members.

    With ``candidates`` a value may come as several groups, as long as sizes are right and so is
    all that these candidates ask. Combos with a unique column of a lineup are then not grouped by
    value, if they are only compared among tables of that lineup: each row is a value of its own."""
    alone = [] if candidates is None else _row_by_row(tables, combos, candidates, count_nulls)
    keys = [f"k{i}" for i in range(len(combos[0]))]
    if not alone:
        return attribute_groups(combo_values(tables, combos, drop_nulls, count_nulls), keys, len(combos))
    nulls = ["null_of"] if count_nulls else []
    rows = combo_values(tables, combos, drop_nulls, count_nulls, alone).groupBy("word", "bit", *nulls)
    groups = rows.agg(F.count(F.lit(1)).alias("n"), *[F.lit(0).cast("bigint").alias("nulls")] * count_nulls)
    groups = groups.withColumn("words", F.array(F.struct(F.col("word").alias("k"), F.col("bit").alias("bits")))).drop("word", "bit")
    rest = sorted(set(range(len(combos))) - set(alone))
    if not rest:
        return groups
    others = attribute_groups(combo_values(tables, combos, drop_nulls, count_nulls, rest), keys, len(combos))
    return groups.unionByName(others.select(*groups.columns))


def _row_by_row(
    tables: TableSet, combos: Sequence[Combo], candidates: Sequence[tuple[Combo, Combo]], count_nulls: bool
) -> list[int]:
    """Members that a lineup has without any null or repeated value, compared with one another only,
    and in one word: then a lineup's row has all members of its value in one bit pattern."""
    shared, _ = _sources(tables, combos, range(len(combos)))
    entry_of, alone = {}, {}
    for number, by_slots in shared.items():
        lineup = tables.lineups[number]
        for slots, by_table in by_slots.items():
            members = list(by_table.values())
            entry_of.update(dict.fromkeys(members, (number, slots)))
            one_word = len({slot(m)[0] for m in members}) == 1
            if one_word and lineup.unique & set(slots) and not (count_nulls and lineup.has_nulls):
                alone[number, slots] = members
    member = {combo: m for m, combo in enumerate(combos)}
    for dep, ref in candidates:
        if dep in member and ref in member:
            one, other = entry_of.get(member[dep]), entry_of.get(member[ref])
            if one != other:
                alone.pop(one, None)
                alone.pop(other, None)
    return sorted(m for members in alone.values() for m in members)


def combo_inclusions(
    tables: TableSet,
    combos: Sequence[Combo],
    drop_nulls: bool = True,
    candidates: Sequence[tuple[Combo, Combo]] | None = None,
) -> DataFrame:
    """(m, size, refs): as for columns, with m the position of the combo in the given list.

    With ``candidates`` refs need only be right for these."""
    return inclusions(combo_groups(tables, combos, drop_nulls, candidates=candidates))


def chunk_combos(candidates: Sequence[tuple[Combo, Combo]]) -> list[Combo]:
    return sorted({side for candidate in candidates for side in candidate})


def side_by_side(tables: TableSet, combos: Sequence[Combo]) -> list[Combo]:
    """Combos with the same columns of a lineup next to one another, so that most share a word."""
    shared, rest = _sources(tables, combos, range(len(combos)))
    lined = [m for by_slots in shared.values() for slots in sorted(by_slots) for m in by_slots[slots].values()]
    return [combos[m] for m in [*lined, *rest]]


def check_candidates(
    tables: TableSet, candidates: Sequence[tuple[Combo, Combo]], included: DataFrame, combos: Sequence[Combo]
) -> DataFrame:
    """(dep, ref, size, holds). Results start from the candidates, so inclusions between
    combos that were never asked for cannot appear. A dependent combo that is never seen
    is void: size 0, and its candidates hold. A referenced side that is not among the combos
    means that the candidate is refuted already."""
    number = {combo: m for m, combo in enumerate(combos)}
    schema = pa.schema(
        [("dep", pa.list_(pa.int32())), ("ref", pa.list_(pa.int32())), ("m", pa.int32()), ("ref_m", pa.int32())]
    )
    rows = [(list(dep), list(ref), number[dep], number.get(ref)) for dep, ref in candidates]
    asked = small_table(tables.spark, rows, schema).coalesce(1)  # one chunk, so one small file
    return asked.join(included, "m", "left").select(
        "dep",
        "ref",
        F.coalesce("size", F.lit(0).cast("bigint")).alias("size"),
        (F.col("size").isNull() | F.coalesce(contains("refs", "ref_m"), F.lit(False))).alias("holds"),
    )


# --- sketches -----------------------------------------------------------------------

#: A value sets one of 512 bits of the level that its hash falls into; level l has one in 2^(l+1) of the values.
_LEVELS, _LEVEL_BITS = 32, 9


def combo_sketches(tables: TableSet, combos: Sequence[Combo], drop_nulls: bool = True) -> np.ndarray:
    """One row of 256 words (2 KB) per combo: a bitmap of its values, whatever their number is.

    If X is included in Y, each bit of X's bitmap is set in Y's, on every level. However many values
    there are, some level holds a few hundred of them, and there what is missing in Y shows as a bit.
    Rows are turned into bits where they are read; what is shuffled are at most 256 words of a
    combo for each task. All bitmaps of one chunk come to the driver: 32 MB for 16,384 combos."""
    n = len(combos[0])
    hashed = F.xxhash64(*[f"k{i}" for i in range(n)])
    rest = F.shiftrightunsigned("h", _LEVEL_BITS)
    # The number of zeros that the rest of the hash ends with.
    level = F.least(F.bit_count(rest.bitwiseAND(-rest) - 1), F.lit(_LEVELS - 1))
    words = 1 << (_LEVEL_BITS - 6)
    within = F.shiftright("h", 6).bitwiseAND(F.lit(words - 1)).cast("int")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    slots = (
        combo_values(tables, combos, drop_nulls)
        .select("word", "bit", hashed.alias("h"))
        .groupBy("word", "bit", (level * words + within).alias("slot"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    found = slots.toArrow()
    word, bit, at, bits = (found.column(c).to_numpy() for c in ("word", "bit", "slot", "bits"))
    sketches = np.zeros((len(combos), _LEVELS * words), np.int64)
    for place in range(min(BITS, len(combos))):
        # Combos that share the rows of a lineup also share entries.
        has = (bit >> place) & 1 == 1
        np.bitwise_or.at(sketches, (word[has].astype(np.int64) * BITS + place, at[has]), bits[has])
    return sketches


def not_refuted(tables: TableSet, candidates: Sequence[tuple[Combo, Combo]], drop_nulls: bool = True) -> list[tuple[Combo, Combo]]:
    """The candidates that bitmaps do not refute. What holds is always among them; the rest is still to be checked."""
    combos = chunk_combos(candidates)
    number = {combo: m for m, combo in enumerate(combos)}
    sketches = combo_sketches(tables, combos, drop_nulls)
    dep, ref = (sketches[[number[c[side]] for c in candidates]] for side in (0, 1))
    refuted = (dep & ~ref).any(axis=1)
    return [c for c, out in zip(candidates, refuted.tolist()) if not out]
