"""Level-wise discovery: unary dependencies, then candidates and checks per arity.

The driver only counts levels and holds one bounded chunk of candidates at a time. The
dependencies of every level stay in a table that is written once, from which the next candidates
and the final results are derived.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from subsumo.operators.algebra import consolidate, restrictions_of
from subsumo.operators.candidates import Generator, generator_of, with_chunk, without_void
from subsumo.operators.cells import union_all
from subsumo.operators.lineup import lined_up
from subsumo.operators.nary import Combo, check_candidates, chunk_combos, combo_inclusions, not_refuted, side_by_side
from subsumo.operators.unary import unary_inds
from subsumo.session import counted, materialize, new_folder, small_table
from subsumo.sources.tables import TableSet

Chunk = list[tuple[Combo, Combo]]


_IND = "dep array<int>, ref array<int>"

#: Candidates that one validation job takes unless a chunk size is given.
DEFAULT_CHUNK = 8192


@dataclass
class LevelStats:
    """What a level did. The phases are generation with the count, and validation."""

    arity: int
    candidates: int
    inds: int
    rules: int = 0
    seconds: float = 0.0
    generation_seconds: float = 0.0
    validation_seconds: float = 0.0
    scans: int = 0


@dataclass
class Phases:
    """Seconds of generation and validation, and scans of the tables."""

    generation: float = 0.0
    validation: float = 0.0
    scans: int = 0


@dataclass
class Discovery:
    """Finished levels. ``levels[i]`` has (dep, ref, size) of arity i + 1."""

    tables: TableSet
    consolidates: bool
    levels: list[DataFrame] = field(default_factory=list)
    level_stats: list[LevelStats] = field(default_factory=list)

    def inds(self) -> DataFrame:
        """(dep, ref): everything that was found, of all arities."""
        return union_all([level.select("dep", "ref") for level in self.levels], self.tables.spark, _IND)

    def maximal(self, consolidated: bool | None = None) -> DataFrame:
        """(dep, ref): found dependencies without the direct projections of found larger ones.

        A generator that does not consolidate (binder) keeps all, unless asked to here."""
        if not (self.consolidates if consolidated is None else consolidated):
            return self.inds()
        if not self.levels:
            return self.inds()
        kept = [
            consolidate(level.select("dep", "ref"), above) for level, above in zip(self.levels, self.levels[1:])
        ]
        return union_all([*kept, self.levels[-1].select("dep", "ref")])

    @property
    def num_discovered(self) -> int:
        return sum(s.inds for s in self.level_stats)

    def run_stats(self) -> DataFrame:
        schema = pa.schema(
            [("arity", pa.int32()), ("candidates", pa.int64()), ("inds", pa.int64()), ("rules", pa.int64()),
             ("seconds", pa.float64()), ("generation_seconds", pa.float64()), ("validation_seconds", pa.float64()),
             ("scans", pa.int32())]
        )
        rows = [
            (s.arity, s.candidates, s.inds, s.rules, s.seconds, s.generation_seconds, s.validation_seconds, s.scans)
            for s in self.level_stats
        ]
        return small_table(self.tables.spark, rows, schema)


    def measurements(self) -> DataFrame:
        """(arity, phase, measure, value): what was counted and timed, a row for each figure.

        The phase ``run`` has arity 0 and speaks of the whole run; a level has the phases
        ``generation``, ``validation`` and, for its dependencies and whole time, ``level``."""
        rows = [
            (0, "run", "tables", len(self.tables.tables)),
            (0, "run", "columns", len(self.tables.columns)),
            (0, "run", "levels", len(self.level_stats)),
            (0, "run", "inds", self.num_discovered),
            (0, "run", "seconds", sum(s.seconds for s in self.level_stats)),
        ]
        for s in self.level_stats:
            rows += [
                (s.arity, "generation", "candidates", s.candidates),
                (s.arity, "generation", "seconds", s.generation_seconds),
                (s.arity, "validation", "scans", s.scans),
                (s.arity, "validation", "seconds", s.validation_seconds),
                (s.arity, "level", "inds", s.inds),
                (s.arity, "level", "rules", s.rules),
                (s.arity, "level", "seconds", s.seconds),
            ]
        schema = pa.schema(
            [("arity", pa.int32()), ("phase", pa.string()), ("measure", pa.string()), ("value", pa.float64())]
        )
        return small_table(self.tables.spark, [(a, p, m, float(v)) for a, p, m, v in rows], schema)


class DiscoveryError(RuntimeError):
    """A level failed; ``partial`` has all levels that were finished before."""

    def __init__(self, message: str, partial: Discovery):
        super().__init__(message)
        self.partial = partial


def discover(
    tables: TableSet,
    max_arity: int = -1,
    generator: str | Generator = "apriori",
    restrictions: str = "NO_REPETITIONS",
    exclude_void: bool | None = None,
    chunk_size: int = -1,
    drop_nulls: bool = True,
    count_only: bool = False,
    refute: bool | None = None,
    on_ind: Callable[[Row], None] | None = None,
    on_level: Callable[[DataFrame, int], None] | None = None,
    line_up: bool | None = None,
) -> Discovery:
    """All dependencies up to ``max_arity`` (-1: as far as there are candidates).

    ``on_ind`` gets every dependency and ``on_level`` every finished level as soon as they
    are there. ``exclude_void`` keeps columns without values out of generation.

    With ``refute`` bitmaps of fixed size are taken of all combos of a chunk first, and only
    candidates that they do not refute are checked on all values: one more scan per chunk, but
    a shuffle of nearly only what holds. Unless told, a level does so if more than half of the
    candidates of the level before failed. Results are the same.

    With ``line_up`` rows that tables share in matching columns are written once, before the
    second level, and read in place of the tables from there on. Unless told, a stored set is."""
    generate, generator_excludes, consolidates = generator_of(generator)
    rules = restrictions_of(restrictions)
    excludes = generator_excludes if exclude_void is None else exclude_void
    if count_only:
        max_arity = 1
    found = Discovery(tables, consolidates)
    arity = 1
    try:
        started = time.perf_counter()
        unary, n_inds = counted(as_ind_table(unary_inds(tables, drop_nulls, include_void=not count_only)))
        n_columns = len(tables.columns)
        finish_level(found, unary, 1, n_columns * (n_columns - 1), n_inds, started, on_ind, on_level)
        generating = without_void(unary) if excludes else unary
        last = generating
        while found.level_stats[-1].inds and (max_arity == -1 or arity < max_arity):
            arity += 1
            started = time.perf_counter()
            candidates = counted(generate(last, generating, arity, rules, tables.column_bits).select("dep", "ref"))
            phases = Phases(time.perf_counter() - started)
            if arity == 2 and candidates[1] and lines_up(tables, line_up):
                tables = lined_up(tables, candidates[0])
            checked, n_inds = validated(tables, candidates, chunk_size, drop_nulls, True, expects_failures(found, refute), phases)
            if not candidates[1]:
                break
            if checked is None:
                checked = last.withColumn("holds", F.lit(True)).limit(0)
            last = checked.select("dep", "ref", "size")
            finish_level(found, last, arity, candidates[1], n_inds, started, on_ind, on_level, phases=phases)
    except Exception as error:
        raise DiscoveryError(f"discovery failed at arity {arity}: {error}", found) from error
    return found


def lines_up(tables: TableSet, line_up: bool | None) -> bool:
    return any(t.key_columns is not None for t in tables.tables) if line_up is None else line_up


def expects_failures(found: Discovery, refute: bool | None) -> bool:
    last = found.level_stats[-1]
    return 2 * (last.inds + last.rules) < last.candidates if refute is None else refute


def as_ind_table(unary: DataFrame) -> DataFrame:
    return unary.select(F.array("dep").alias("dep"), F.array("ref").alias("ref"), *unary.columns[2:])


def validated(
    tables: TableSet,
    candidates: DataFrame | tuple[DataFrame, int],
    chunk_size: int = -1,
    drop_nulls: bool = True,
    only_valid: bool = False,
    refute: bool = True,
    phases: Phases | None = None,
) -> tuple[DataFrame | None, int]:
    """((dep, ref, size, holds), number of its rows); no table if no candidate is left.

    All candidates must have the same arity. They come as a table, or as a written table
    with its number of rows. ``phases`` gets the seconds and scans."""
    folder, checked, n_rows = new_folder(tables.spark, "checked"), None, 0
    started, phases_of = time.perf_counter(), phases or Phases()
    for chunk in candidate_chunks(candidates, chunk_size, tables.column_bits):
        left = not_refuted(tables, chunk, drop_nulls) if refute else chunk
        phases_of.scans += refute
        if only_valid:
            asked, combos = left, chunk_combos(left)
        else:
            # The size of every dependent side is wanted, but a refuted referenced side is not read.
            asked, combos = chunk, sorted({dep for dep, _ in chunk} | {ref for _, ref in left})
        if asked:
            combos = side_by_side(tables, combos)
            results = check_candidates(tables, asked, combo_inclusions(tables, combos, drop_nulls, asked), combos)
            checked, n = counted(results.where("holds") if only_valid else results, folder)
            n_rows += n
            phases_of.scans += 1
    phases_of.validation = time.perf_counter() - started
    return checked, n_rows


def candidate_chunks(candidates: DataFrame | tuple[DataFrame, int], chunk_size: int = -1, column_bits: int = 16) -> Iterator[Chunk]:
    """Candidates in bounded pieces. Every piece is one validation job.

    A given size is kept to. Candidates are computed once: unless they come as a written
    table with its number of rows, they become one here."""
    limit = chunk_size if chunk_size > 0 else DEFAULT_CHUNK
    written, n = candidates if isinstance(candidates, tuple) else counted(candidates.select("dep", "ref"))
    if n <= limit:
        if n:
            yield _as_chunk(written.collect())
        return
    # Sorted by chunk, so that reading a chunk skips the files of all others.
    numbered = with_chunk(written, limit, column_bits)
    numbered = materialize(numbered.repartitionByRange("chunk").sortWithinPartitions("chunk"))
    for number in range(-(-n // limit)):
        yield _as_chunk(numbered.where(F.col("chunk") == number).collect())


def _as_chunk(rows: list[Row]) -> Chunk:
    return [(tuple(r["dep"]), tuple(r["ref"])) for r in rows]


def finish_level(found, level, arity, n_candidates, n, started, on_ind, on_level, n_rules=0, phases=None) -> None:
    """Records a written level of n dependencies, then hands it to the callbacks."""
    found.levels.append(level)
    phases = phases or Phases()
    found.level_stats.append(
        LevelStats(
            arity, n_candidates, n, n_rules, time.perf_counter() - started, phases.generation, phases.validation, phases.scans
        )
    )
    if on_level:
        on_level(level, arity)
    if on_ind:
        for row in level.toLocalIterator():
            on_ind(row)
