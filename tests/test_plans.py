"""Whole discovery runs against brute force, and what happens around them."""

import random
from itertools import combinations, permutations

import pytest
from ind_samples import ind_set

from subsumo import DiscoveryError, TableSet, discover, discover_with_rules
from subsumo.operators.candidates import apriori_candidates
from subsumo.plans import discovery
from subsumo.sinks import (
    for_each,
    level_writer,
    read_collection,
    read_measurements,
    save,
    save_collection,
    save_measurements,
)


def related_tables(spark, seed, null_rate=0.0, stored=False):
    """A table and a part of its rows with columns in another order."""
    rng = random.Random(seed)
    draw = lambda: None if rng.random() < null_rate else rng.choice("abc")
    whole = [[draw() for _ in range(4)] for _ in range(14)]
    part = [[row[i] for i in (2, 0, 1)] for row in whole[:9]]
    frames = {
        "whole": spark.createDataFrame([tuple(r) for r in whole], "a string, b string, c string, d string"),
        "part": spark.createDataFrame([tuple(r) for r in part], "x string, y string, z string"),
    }
    return [whole, part], TableSet.from_dataframes(spark, frames)


def holds(data, dep, ref):
    values = lambda cols: {
        t for row in data[cols[0] >> 16] if None not in (t := tuple(row[c & 65535] for c in cols))
    }
    return values(dep) <= values(ref)


def brute_force(data):
    """All dependencies without repeated columns; complete on data without nulls."""
    found = set()
    columns = [[(n << 16) + j for j in range(len(rows[0]))] for n, rows in enumerate(data)]
    for a in columns:
        for b in columns:
            for k in range(1, min(len(a), len(b)) + 1):
                for dep in combinations(a, k):
                    for ref in permutations(b, k):
                        if not set(dep) & set(ref) and holds(data, dep, ref):
                            found.add((dep, ref))
    return found


def maximal(inds):
    pairs = lambda i: set(zip(*i))
    return {i for i in inds if not any(len(j[0]) == len(i[0]) + 1 and pairs(i) < pairs(j) for j in inds)}


def test_generators_and_chunks_agree(spark):
    data, tables = related_tables(spark, 1)
    expected = brute_force(data)
    assert max(len(d) for d, _ in expected) >= 2
    plain = discover(tables)
    assert ind_set(plain.inds()) == expected
    for options in ({"chunk_size": 20, "refute": True}, {"refute": False}, {"generator": "apriori-no-void"}):
        found = discover(tables, **options)
        assert ind_set(found.inds()) == expected
        assert ind_set(found.maximal()) == maximal(expected)
        counts = [(s.candidates, s.inds) for s in found.level_stats]
        assert counts == [(s.candidates, s.inds) for s in plain.level_stats]
    binder = discover(tables, generator="binder")
    assert ind_set(binder.maximal()) == expected
    assert ind_set(binder.maximal(consolidated=True)) == maximal(expected)


def level_wise(data):
    """Level by level with nulls left out, as candidates need all their projections."""
    columns = [(n << 16) + j for n, rows in enumerate(data) for j in range(len(rows[0]))]
    level = {((a,), (b,)) for a in columns for b in columns if a != b and holds(data, (a,), (b,))}
    found = set(level)
    while level:
        merged = set()
        for d1, r1 in level:
            for d2, r2 in level:
                same = d1[:-1] == d2[:-1] and r1[:-1] == r2[:-1]
                if same and (d1[0] >> 16, r1[0] >> 16) == (d2[0] >> 16, r2[0] >> 16) and d1[-1] < d2[-1]:
                    dep, ref = (*d1, d2[-1]), (*r1, r2[-1])
                    if r1[-1] != r2[-1] and d1[-1] != r2[-1] and d2[-1] != r1[-1]:
                        if all((dep[:i] + dep[i + 1 :], ref[:i] + ref[i + 1 :]) in level for i in range(len(dep))):
                            merged.add((dep, ref))
        level = {c for c in merged if holds(data, *c)}
        found |= level
    return found


def test_nulls_left_out(spark):
    data, tables = related_tables(spark, 5, null_rate=0.35)
    assert ind_set(discover(tables).inds()) == level_wise(data)


def test_nulls_kept(spark):
    data, tables = related_tables(spark, 6, null_rate=0.2)
    as_values = [[["null" if v is None else v for v in row] for row in rows] for rows in data]
    assert ind_set(discover(tables, drop_nulls=False).inds()) == brute_force(as_values)


def test_rules_restore_what_they_removed(spark):
    """On data without nulls, kept dependencies and rules together give back all of them."""
    data, tables = related_tables(spark, 3)
    found = discover_with_rules(tables)
    known = ind_set(found.inds())
    rules = [tuple(tuple(x) for x in r) for r in found.rules().collect()]
    pairs = lambda i: frozenset(zip(*i))
    known_pairs = {pairs(i) for i in known} | {frozenset()}
    grown = True
    while grown:
        new = set()
        for lhs_dep, lhs_ref, rhs_dep, rhs_ref in rules:
            left, right = pairs((lhs_dep, lhs_ref)), pairs((rhs_dep, rhs_ref))
            new |= {k | right for k in known_pairs if left <= k}
        grown = not new <= known_pairs
        known_pairs |= new
    valid = {pairs(i) for i in brute_force(data)}
    assert valid <= known_pairs
    other = discover_with_rules(tables, chunk_size=8, refute=False)
    assert ind_set(other.inds()) == known
    assert sorted(map(str, other.rules().collect())) == sorted(map(str, found.rules().collect()))


def test_bound_of_one_job(spark, monkeypatch):
    """More candidates than one job takes are checked in several, none is lost."""
    data, tables = related_tables(spark, 1)
    monkeypatch.setattr(discovery, "DEFAULT_CHUNK", 9)
    found = discover(tables, max_arity=3, refute=True)
    assert ind_set(found.inds()) == {i for i in brute_force(data) if len(i[0]) <= 3}
    chunks = -(-found.level_stats[1].candidates // 9)
    assert chunks < found.level_stats[1].scans <= 2 * chunks  # bitmaps of each chunk, values of what is left


def test_chunks_have_the_asked_size(spark):
    rows = spark.range(2500).selectExpr("array(cast(id as int), 65536) AS dep", "array(131072, cast(id as int)) AS ref")
    assert [len(c) for c in discovery.candidate_chunks(rows, 2000)] == [2000, 500]
    assert [len(c) for c in discovery.candidate_chunks(rows)] == [2500]


def test_a_failed_first_level_leaves_empty_results(spark):
    tables = TableSet.from_dataframes(spark, {"t": spark.sql("SELECT raise_error('no') AS a, 1 AS b")})
    with pytest.raises(DiscoveryError, match="arity 1") as failure:
        discover(tables)
    assert failure.value.partial.inds().count() == failure.value.partial.maximal().count() == 0


def test_generators_say_how_they_are_run(spark):
    def own(last, unary, arity, restrictions, bits):
        return apriori_candidates(last, unary, arity, restrictions, bits)

    own.consolidates = False
    _, tables = related_tables(spark, 1)
    found = discover(tables, max_arity=2, generator=own)
    assert ind_set(found.maximal()) == ind_set(found.inds())


def test_max_arity_and_stats(spark):
    _, tables = related_tables(spark, 1)
    found = discover(tables, max_arity=2)
    rows = found.run_stats().orderBy("arity").collect()
    assert [r.arity for r in rows] == [1, 2]
    assert rows[0].candidates == 42
    assert [r.inds for r in rows] == [level.count() for level in found.levels]
    assert found.num_discovered == found.inds().count()


def test_finished_levels_survive_a_failure(spark, tmp_path):
    _, tables = related_tables(spark, 1)

    def failing(last, unary, arity, restrictions, bits):
        if arity == 3:
            raise RuntimeError("no more")
        return apriori_candidates(last, unary, arity, restrictions, bits)

    path = str(tmp_path / "found")
    with pytest.raises(DiscoveryError, match="arity 3") as failure:
        discover(tables, generator=failing, on_level=level_writer(path, dataset="test"))
    partial = failure.value.partial
    saved = spark.read.parquet(path)
    assert len(partial.levels) == 2
    assert ind_set(saved) == ind_set(partial.inds())
    assert {r.arity for r in saved.select("arity").distinct().collect()} == {1, 2}


def test_saved_results(spark, tmp_path):
    df = spark.createDataFrame([([1], [2])], "dep array<int>, ref array<int>")
    path = str(tmp_path / "inds")
    first = save(df, path, algorithm="a", dataset="d")
    second = save(df, path)
    rows = spark.read.parquet(path).collect()
    assert {r.run_id for r in rows} == {first, second}
    assert {(r.algorithm, r.dataset) for r in rows} == {("a", "d"), ("discover", "")}
    save(df, table="found_inds")
    assert spark.table("found_inds").count() == 1
    with pytest.raises(ValueError):
        save(df)
    seen = []
    for_each(df, seen.append)
    assert [r.dep for r in seen] == [[1]]


def test_collections(spark, tmp_path):
    """Saving again replaces a collection, with its columns and run, and leaves the others."""
    folder = str(tmp_path / "collections")
    _, tables = related_tables(spark, 1)
    found = discover(tables, max_arity=2)
    for name, inds in (("a", found.inds()), ("b", found.levels[0].select("dep", "ref")), ("a", found.levels[1].select("dep", "ref"))):
        save_collection(inds, folder, name, tables, "discover", "related", {"max_arity": "2"})
    for name, level in (("a", found.levels[1]), ("b", found.levels[0])):
        inds, columns, run = read_collection(spark, folder, name)
        assert ind_set(inds) == ind_set(level) and inds.count() == level.count()
        assert sorted(map(tuple, columns.collect())) == sorted(map(tuple, tables.registry().collect()))
        assert [(r.algorithm, r.dataset, r.settings) for r in run.collect()] == [("discover", "related", {"max_arity": "2"})]
    assert read_collection(spark, folder, "c")[0].count() == 0


def test_measurements(spark, tmp_path):
    """Runs are kept side by side; a run saved again replaces its own figures."""
    folder = str(tmp_path / "measurements")
    _, tables = related_tables(spark, 1)
    one, two = discover(tables, max_arity=1), discover(tables, max_arity=2)
    save_measurements(one.measurements(), folder, "7", "discover", "first")
    other = save_measurements(one.measurements(), folder)
    save_measurements(two.measurements(), folder, "7", "discover", "second")
    rows = read_measurements(spark, folder, "7").collect()
    assert {(r.run_id, r.dataset) for r in rows} == {("7", "second")}
    figures = {(r.arity, r.phase, r.measure): r.value for r in rows}
    assert len(figures) == len(rows) == 5 + 7 * 2
    assert figures[0, "run", "columns"] == 7 and figures[0, "run", "inds"] == two.num_discovered
    for s in two.level_stats:
        assert figures[s.arity, "generation", "candidates"] == s.candidates
        assert (figures[s.arity, "level", "inds"], figures[s.arity, "validation", "scans"]) == (s.inds, s.scans)
    assert {r.run_id for r in read_measurements(spark, folder).collect()} == {"7", other}
    assert read_measurements(spark, folder, "8").count() == 0
