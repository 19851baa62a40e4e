"""Dependency algebra and candidate generation against brute force."""

import random
from itertools import combinations, permutations

import pytest
from ind_samples import ind_set
from pyspark.sql import functions as F

from subsumo.operators import algebra
from subsumo.operators.candidates import (
    apriori_candidates,
    binder_candidates,
    combos,
    generator_of,
    restrict_combos,
    with_chunk,
    without_void,
)
from subsumo.plans.borders import Border

BASE = [0, 1 << 16]
SCHEMA = "dep array<int>, ref array<int>"


def random_inds(seed, n, arities=(1, 2, 3)):
    rng = random.Random(seed)
    inds = set()
    while len(inds) < n:
        k = rng.choice(arities)
        a, b = rng.choice([(0, 1), (1, 0), (0, 0)])
        dep = sorted(rng.sample(range(4), k))
        ref = rng.sample(range(4), k)
        inds.add((tuple(BASE[a] + d for d in dep), tuple(BASE[b] + r for r in ref)))
    return inds


def frame(spark, inds):
    return spark.createDataFrame([(list(d), list(r)) for d, r in sorted(inds)], SCHEMA)


def pairs(ind):
    return set(zip(*ind))


INDS = random_inds(7, 60)


@pytest.fixture(scope="module")
def inds(spark):
    df = frame(spark, INDS).cache()
    df.count()
    return df


def test_borders(inds):
    maximal = {i for i in INDS if not any(pairs(i) < pairs(j) for j in INDS)}
    minimal = {i for i in INDS if not any(pairs(j) < pairs(i) for j in INDS)}
    assert ind_set(algebra.positive_border(inds)) == maximal
    assert ind_set(algebra.negative_border(inds)) == minimal
    assert algebra.positive_border(inds).count() == len(maximal)
    assert algebra.negative_border(inds).count() == len(minimal)


@pytest.mark.parametrize("kind", ["positive", "negative"])
def test_borders_are_kept_up(spark, kind):
    """Levels in either order, mixed arities, repeated rows and nothing at all give what one batch does."""
    levels = [{i for i in INDS if len(i[0]) == k} for k in (1, 2, 3)]
    mixed = random_inds(12, 30)
    whole = algebra.positive_border if kind == "positive" else algebra.negative_border
    for order in (levels, levels[::-1], [levels[1], mixed, levels[0] | levels[2], levels[1]]):
        border, seen = Border(spark, kind), set()
        for level in [set(), *order]:
            seen |= level
            border.add(frame(spark, level).unionByName(frame(spark, sorted(level)[:3])))
            expected = {
                i for i in seen
                if not any(pairs(i) < pairs(j) if kind == "positive" else pairs(j) < pairs(i) for j in seen)
            }
            assert ind_set(border.df) == expected and border.size == border.df.count() == len(expected)
        assert ind_set(border.df) == ind_set(whole(frame(spark, seen)))
    with pytest.raises(ValueError):
        Border(spark, "other")


@pytest.mark.parametrize("k", [1, 2, 3])
def test_implied(inds, k):
    expected = set()
    for dep, ref in INDS:
        for at in combinations(range(len(dep)), k):
            expected.add((tuple(dep[i] for i in at), tuple(ref[i] for i in at)))
    got = algebra.implied(inds, k)
    assert ind_set(got) == expected and got.count() == len(expected)


def test_consolidate(spark, inds):
    new = random_inds(8, 10, (2, 3))
    gone = {
        (d[:i] + d[i + 1 :], r[:i] + r[i + 1 :]) for d, r in new for i in range(len(d))
    }
    assert ind_set(algebra.consolidate(inds, frame(spark, new))) == INDS - gone


def test_coprojections_and_projections(inds):
    rows = algebra.coprojections(inds).collect()
    assert len(rows) == sum(len(d) for d, _ in INDS)
    assert all(r.c_dep == r.dep[: r.position] + r.dep[r.position + 1 :] for r in rows)
    assert all(r.c_ref == r.ref[: r.position] + r.ref[r.position + 1 :] for r in rows)
    rows = algebra.projections(inds).collect()
    assert all((r.p_dep, r.p_ref) == ([r.dep[r.position]], [r.ref[r.position]]) for r in rows)


def test_relations(spark):
    some = sorted(random_inds(9, 25))
    both = [(*map(list, a), *map(list, b)) for a in some for b in some]
    df = spark.createDataFrame(both, "a_dep array<int>, a_ref array<int>, b_dep array<int>, b_ref array<int>")
    sides = [F.col(c) for c in ("a_dep", "a_ref", "b_dep", "b_ref")]
    rows = df.select(
        "*",
        algebra.is_implied_by(*sides).alias("implied"),
        algebra.is_specializing(*sides).alias("special"),
        algebra.is_disjoint(*sides).alias("disjoint"),
    ).collect()
    for r in rows:
        a, b = pairs((r.a_dep, r.a_ref)), pairs((r.b_dep, r.b_ref))
        assert r.implied == (a <= b) and r.special == (a > b) and r.disjoint == (not a & b)


def test_orders(inds):
    rows = [(tuple(r.dep), tuple(r.ref)) for r in algebra.by_arity(inds).collect()]
    assert rows == sorted(INDS, key=lambda i: (len(i[0]), i))
    rows = [(tuple(r.dep), tuple(r.ref)) for r in algebra.lexicographic(inds).collect()]
    assert rows == sorted(INDS)


def test_canonical(spark):
    df = spark.createDataFrame([([3, 1, 3], [9, 8, 7]), ([2, 2], [5, 5])], SCHEMA)
    assert [(r.dep, r.ref) for r in algebra.canonical(df).collect()] == [([1, 3, 3], [8, 7, 9]), ([2], [5])]


def test_set_tests(spark):
    cases = {
        ((1, 2), (65536, 65537)): (True, True, 6),
        ((1, 1), (65536, 65537)): (False, False, 3),
        ((1, 2), (2, 3)): (True, False, 4),
        ((1, 2), (1, 65537)): (True, False, 2),
    }
    for (dep, ref), (sides, everywhere, n_satisfied) in cases.items():
        df = frame(spark, [(dep, ref)])
        levels = [algebra.satisfies(name).alias(name) for name in algebra.RESTRICTIONS]
        row = df.select(algebra.is_non_repeating().alias("s"), algebra.is_non_repeating(each_side=False).alias("e"), *levels).first()
        assert (row.s, row.e, sum(row[name] for name in algebra.RESTRICTIONS)) == (sides, everywhere, n_satisfied)
    assert frame(spark, [((1,), (1,))]).select(algebra.is_trivial().alias("t")).first().t


def test_groupings(inds):
    counted = {(r.dep_table, r.ref_table, r.arity): r.n for r in algebra.by_subspace(inds).collect()}
    assert sum(counted.values()) == len(INDS)
    assert counted[0, 1, 2] == sum(1 for d, r in INDS if len(d) == 2 and d[0] < 65536 <= r[0])
    per_dep = {tuple(r.dep): r.refs for r in algebra.by_dependent(inds, 2).collect()}
    for dep, refs in per_dep.items():
        assert refs == sorted(list(r) for d, r in INDS if d == dep)


# --- candidates ---------------------------------------------------------------------


def expected_apriori(known, arity, rules):
    """All ordered pair lists of the arity whose direct projections are all known."""
    by_space = {}
    for dep, ref in known:
        by_space.setdefault((dep[0] >> 16, ref[0] >> 16), set()).add(tuple(zip(dep, ref)))
    found = set()
    for (a, b), items in by_space.items():
        single = sorted({p for i in items for p in i})
        for chosen in combinations(single, arity):
            parts = [chosen[:i] + chosen[i + 1 :] for i in range(arity)]
            needed = parts if not rules.trivial else [p for p in parts[:-2] if any(d != r for d, r in p)] + parts[-2:]
            if not all(p in items for p in needed):
                continue
            (d1, r1), (d2, r2) = chosen[-2:]
            if not rules.intra and (d1 >= d2 or r1 == r2):
                continue
            if not rules.inter and a == b and (d1 == r2 or d2 == r1):
                continue
            found.add(tuple(zip(*chosen)))
    return found


@pytest.mark.parametrize("name", list(algebra.RESTRICTIONS))
def test_apriori(spark, name):
    rules = algebra.RESTRICTIONS[name]
    rng = random.Random(11)
    single = [((BASE[a] + d,), (BASE[b] + r,)) for a, b in [(0, 1), (0, 0)] for d, r in permutations(range(4), 2)]
    single = set(rng.sample(single, 18))
    two = apriori_candidates(frame(spark, single), None, 2, name)
    expected_two = expected_apriori(single, 2, rules)
    assert ind_set(two) == expected_two and two.count() == len(expected_two)
    known = set(rng.sample(sorted(expected_two), int(len(expected_two) * 0.8)))
    three = apriori_candidates(frame(spark, known), None, 3, name)
    expected_three = expected_apriori(known, 3, rules)
    assert expected_three and ind_set(three) == expected_three and three.count() == len(expected_three)


def test_binder(spark):
    single = {i for i in INDS if len(i[0]) == 1}
    two = {i for i in INDS if len(i[0]) == 2}
    expected = set()
    for dep, ref in two:
        for (d,), (r,) in single:
            same = (d >> 16, r >> 16) == (dep[0] >> 16, ref[0] >> 16)
            if same and d > max(dep) and r not in ref and r not in dep and d not in ref:
                expected.add(((*dep, d), (*ref, r)))
    got = binder_candidates(frame(spark, two), frame(spark, single), 3)
    assert expected and ind_set(got) == expected
    with pytest.raises(ValueError):
        binder_candidates(frame(spark, two), frame(spark, single), 3, "NO_TRIVIAL")


def test_generator_names():
    assert generator_of("mind") == generator_of("apriori")
    assert generator_of("mind-no-void")[1] and generator_of("binder")[1:] == (True, False)
    with pytest.raises(ValueError):
        generator_of("other")
    with pytest.raises(ValueError):
        algebra.restrictions_of("other")


def test_void_exclusion(spark):
    df = spark.createDataFrame([([1], [2], 0), ([2], [1], 3)], SCHEMA + ", size long")
    assert ind_set(without_void(df)) == {((2,), (1,))}


def test_combos_and_chunks(spark, inds):
    numbered = combos(inds)
    rows = numbered.collect()
    sides = {s for i in INDS for s in i}
    assert {tuple(r.cols) for r in rows} == sides
    assert sorted(r.combo_id for r in rows) == list(range(len(sides)))
    assert all(r.table == r.cols[0] >> 16 for r in rows)
    chunked = with_chunk(inds, 7).collect()
    sizes = [sum(1 for r in chunked if r.chunk == c) for c in range(9)]
    assert sizes == [7] * 8 + [4]
    one = frame(spark, list(INDS)[:1])
    assert {tuple(r.cols) for r in restrict_combos(numbered, one).collect()} == set(list(INDS)[0])
