"""Small data sets with results that are known in full."""

import pytest
from ind_samples import expected_inds, ids, ind_set

from subsumo import Dialect, csv_tables, discover, discover_with_rules, partial_unary_inds
from subsumo.operators.naming import named

PQ = ids("p", "q")
LX = ids("l", "x")
VOID = ["p3", "p4", "q3", "q4"]
ALL_PQ = [f"{t}{i}" for t in "pq" for i in range(6)]
NAMES = ["p0<q0", "q0<p0", "p2<q1", "q1<p2"]


@pytest.fixture(scope="module")
def people(spark, files):
    paths = {"persons.tsv": files["persons.tsv"], "planets.tsv": files["planets.tsv"]}
    return csv_tables(spark, paths, Dialect(separator="\t"), null_string=r"\N")


@pytest.fixture(scope="module")
def letters(spark, files):
    paths = {"letters.csv": files["letters.csv"], "letters-ext.csv": files["letters-ext.csv"]}
    return csv_tables(spark, paths, Dialect(separator=","))


def test_unary_without_nulls(people):
    found = discover(people, max_arity=1)
    void = [f"{v}<{c}" for v in VOID for c in ALL_PQ if v != c]
    assert len(void) == 44
    assert ind_set(found.maximal()) == expected_inds(PQ, *NAMES, *void)
    assert found.num_discovered == 48


def test_unary_with_nulls_as_values(people):
    with_nulls = ["p1", "p2", "p3", "p4", "q1", "q3", "q4"]
    nulls = [f"{v}<{c}" for v in VOID for c in with_nulls if v != c]
    found = discover(people, max_arity=1, drop_nulls=False)
    assert ind_set(found.maximal()) == expected_inds(PQ, *NAMES, *nulls)


NARY = expected_inds(LX, "l0 l1 l2 l3<x0 x1 x2 x3", "x1 x2 x3<l1 l2 l3")


@pytest.mark.parametrize("chunk_size", [-1, 1])
def test_nary(letters, chunk_size):
    found = discover(letters, chunk_size=chunk_size)
    assert ind_set(found.maximal()) == NARY
    assert [s.inds for s in found.level_stats] == [7, 9, 5, 1]
    assert [s.candidates for s in found.level_stats[1:]] == [9, 5, 1]


def test_nary_callbacks(letters):
    seen, levels = [], []
    found = discover(letters, max_arity=2, on_ind=seen.append, on_level=lambda df, arity: levels.append((arity, df.count())))
    assert len(seen) == found.num_discovered == 16
    assert levels == [(1, 7), (2, 9)]


@pytest.mark.parametrize("chunk_size", [-1, 1])
def test_rules(letters, chunk_size):
    found = discover_with_rules(letters, chunk_size=chunk_size)
    assert ind_set(found.maximal()) == expected_inds(
        LX, "l0 l1 l3<x0 x1 x3", "l0 l2 l3<x0 x2 x3", "l0 l1 l2<x0 x1 x2", "x1 x3<l1 l3", "x2 x3<l2 l3", "x1 x2<l1 l2"
    )
    assert rule_set(found) == {
        (*side("l2 l3<x2 x3"), *side("l1<x1")),
        (*side("l1 l3<x1 x3"), *side("l2<x2")),
        (*side("x2 x3<l2 l3"), *side("x1<l1")),
        (*side("x1 x3<l1 l3"), *side("x2<l2")),
    }


def test_rules_with_void_columns(people):
    found = discover_with_rules(people)
    assert ind_set(found.maximal()) == expected_inds(PQ, *NAMES)
    rules = rule_set(found)
    zero_ary = {r for r in rules if not r[0]}
    assert zero_ary == {((), (), tuple(PQ(v)), tuple(PQ(c))) for v in VOID for c in ALL_PQ if v != c}
    assert rules - zero_ary == {
        (tuple(PQ("p2")), tuple(PQ("q1")), tuple(PQ("p0")), tuple(PQ("q0"))),
        (tuple(PQ("q1")), tuple(PQ("p2")), tuple(PQ("q0")), tuple(PQ("p0"))),
    }


def test_partial(spark, files):
    paths = {"persons.tsv": files["persons.tsv"], "planets.tsv": files["planets.tsv"]}
    tables = csv_tables(spark, paths, Dialect(separator="\t"))
    rows = {(r.dep, r.ref): (r.dep_size, r.overlap) for r in partial_unary_inds(tables, 0.0).collect()}
    for pair in NAMES:
        dep, ref = (PQ(s)[0] for s in pair.split("<"))
        assert rows[dep, ref] == (4, 1.0)
    assert rows[PQ("p1")[0], PQ("p2")[0]] == (3, pytest.approx(1 / 3))


def test_partial_never_reports_void_columns(people):
    deps = {r.dep for r in partial_unary_inds(people, 0.0).collect()}
    assert not deps & {PQ(v)[0] for v in VOID}


def test_named_columns(spark, files):
    paths = {"letters.csv": files["letters.csv"], "letters-ext.csv": files["letters-ext.csv"]}
    tables = csv_tables(spark, paths, Dialect(separator=","), null_string="")
    rows = named(discover(tables, generator="mind").maximal(), tables).collect()
    full = lambda side: [f"{t}.{c}" for t, c in side]
    assert sorted((full(r.dep_names), full(r.ref_names)) for r in rows) == [
        ([f"letters-ext.csv.column{i}" for i in (2, 3, 4)], [f"letters.csv.column{i}" for i in (2, 3, 4)]),
        ([f"letters.csv.column{i}" for i in (1, 2, 3, 4)], [f"letters-ext.csv.column{i}" for i in (1, 2, 3, 4)]),
    ]


def rule_set(found):
    return {tuple(tuple(x) for x in r) for r in found.rules().select("lhs_dep", "lhs_ref", "rhs_dep", "rhs_ref").collect()}


def side(text):
    dep, ref = text.split("<")
    return tuple(LX(dep)), tuple(LX(ref))
