"""Tables lined up column by column: rows that they share, or that repeat in one, are kept once.

Where dependencies hold, tables share most of their rows. A lineup has each distinct row of its
tables in their matched columns, and how often each table has it. All combos of these columns are
read from there, on every level. What is matched decides how small a lineup is, never a result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsumo.operators.cells import union_all
from subsumo.session import counted
from subsumo.sources.tables import TableSet

#: Tables of one lineup, and column pairs that lineups are chosen from.
MOST_TABLES, MOST_PAIRS = 4, 8192

#: A column with fewer values than this part of the rows, as estimated, is not tested for being unique.
_LEAST_UNIQUE = 0.8

Combo = tuple[int, ...]


@dataclass
class Lineup:
    """``df`` has the matched columns' grouping keys s0, s1, … and n0, n1, …, the rows of each table."""

    df: DataFrame
    tables: list[int]
    #: Column id to place among s0, s1, …
    slots: dict[int, int]
    #: Slots without nulls in which no two rows agree.
    unique: set[int]
    has_nulls: bool

    def place(self, combo: Combo, column_bits: int) -> tuple[int, Combo] | None:
        """(place of the table, slots of the columns), if all of them are matched."""
        if not all(c in self.slots for c in combo):
            return None
        return self.tables.index(combo[0] >> column_bits), tuple(self.slots[c] for c in combo)


def lined_up(tables: TableSet, candidates: DataFrame) -> TableSet:
    """The same set with lineups of the tables whose columns these candidates (dep, ref) pair most often."""
    pairs = (
        candidates.select(F.inline(F.arrays_zip("dep", "ref")))
        .select(F.least("dep", "ref").alias("a"), F.greatest("dep", "ref").alias("b"))
        .where(tables.table_number_of(F.col("a")) != tables.table_number_of(F.col("b")))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "a", "b")
        .limit(MOST_PAIRS)
    )
    out = replace(tables)
    out.width_violations = tables.width_violations
    out.lineups = [_written(tables, columns) for columns in matched([tuple(r) for r in pairs.collect()], tables.column_bits)]
    return out


def matched(pairs: list[tuple[int, int, int]], column_bits: int) -> list[list[list[int]]]:
    """Of (column, column, weight), heaviest first: lineups as lists of tables, each a list of column ids by slot.

    Two tables are matched in at least two columns; a table is in one lineup, and a further one
    joins it if it has a column for every slot."""
    weights, partner = defaultdict(int), defaultdict(dict)
    for a, b, n in pairs:
        key = a >> column_bits, b >> column_bits
        if a not in partner[key] and b not in partner[key].values():
            partner[key][a] = b
            weights[key] += n
    found, lineup_of = [], {}
    for key in sorted(weights, key=lambda k: (-weights[k], k)):
        (one, other), to_other = key, partner[key]
        if one not in lineup_of and other not in lineup_of:
            if len(to_other) > 1:
                lineup_of[one] = lineup_of[other] = len(found)
                found.append([sorted(to_other), [to_other[a] for a in sorted(to_other)]])
        elif one not in lineup_of or other not in lineup_of:
            known = one if one in lineup_of else other
            step = to_other if known == one else {b: a for a, b in to_other.items()}
            lineup = found[lineup_of[known]]
            columns = next(c for c in lineup if c[0] >> column_bits == known)
            if len(lineup) < MOST_TABLES and all(c in step for c in columns):
                lineup_of[one] = lineup_of[other] = lineup_of[known]
                lineup.append([step[c] for c in columns])
    return found


def _written(tables: TableSet, columns: list[list[int]]) -> Lineup:
    names = [f"s{i}" for i in range(len(columns[0]))]
    numbers = [c[0] >> tables.column_bits for c in columns]
    parts = []
    for at, (number, ids) in enumerate(zip(numbers, columns)):
        table = next(t for t in tables.tables if t.number == number)
        places = [c & tables.mask for c in ids]
        keys = tables.keys(table, sorted(places))
        parts.append(keys.select(*[F.col(f"c{i}").alias(name) for i, name in zip(places, names)], F.lit(at).alias("at")))
    rows = [F.count(F.when(F.col("at") == at, True)).alias(f"n{at}") for at in range(len(columns))]
    df, n = counted(union_all(parts).groupBy(*names).agg(*rows))
    seen = df.agg(*[F.count(s) for s in names], *[F.approx_count_distinct(s) for s in names]).first()
    filled, values = seen[: len(names)], seen[len(names) :]
    likely = [i for i, s in enumerate(names) if filled[i] == n and values[i] >= _LEAST_UNIQUE * n]
    unique = {i for i in likely if df.select(names[i]).distinct().count() == n}
    slots = {c: i for ids in columns for i, c in enumerate(ids)}
    return Lineup(df, numbers, slots, unique, min(filled) < n)
