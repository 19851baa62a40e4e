"""Lineups of tables against the tables themselves."""

import random

import pytest
from ind_samples import ind_set
from test_plans import level_wise

from subsumo import TableSet, discover, discover_with_rules
from subsumo.operators.lineup import lined_up, matched
from subsumo.operators.nary import _row_by_row, combo_groups, combo_values, side_by_side
from subsumo.plans.discovery import validated

PEOPLE = "id int, home string, work string, kind string"


def orders_and_lines(spark, null_rate=0.0):
    """Rows with a key, some of them several times in another table with its columns in another order."""
    rng = random.Random(4)
    draw = lambda n: None if rng.random() < null_rate else f"v{rng.randrange(n)}"
    orders = [(i, draw(9), draw(3), draw(2)) for i in range(60)]
    lines = [orders[rng.randrange(50)] for _ in range(200)]
    lines = [(home, i, kind, work) for i, home, work, kind in lines]
    few = [(f"v{i}", f"v{i % 2}") for i in range(3)]
    frames = {
        "orders": spark.createDataFrame(orders, PEOPLE),
        "lines": spark.createDataFrame(lines, "home string, id int, kind string, work string"),
        "few": spark.createDataFrame(few, "a string, b string"),
    }
    as_text = lambda rows: [[v if v is None else str(v) for v in row] for row in rows]
    return [as_text(rows) for rows in (orders, lines, few)], TableSet.from_dataframes(spark, frames)


def levels(found):
    return [sorted((tuple(r.dep), tuple(r.ref), r["size"]) for r in level.collect()) for level in found.levels]


@pytest.mark.parametrize("null_rate", [0.0, 0.2])
def test_levels_are_those_of_the_tables(spark, null_rate):
    data, tables = orders_and_lines(spark, null_rate)
    plain = discover(tables, line_up=False)
    assert len(plain.levels) == 4 and ind_set(plain.inds()) == level_wise(data)
    stored = tables.stored(distinct=["lines"])
    assert levels(discover(stored, refute=None if null_rate else False)) == levels(plain)
    if null_rate:
        kept = discover(tables, max_arity=3, drop_nulls=False, line_up=False)
        assert levels(discover(stored, max_arity=3, drop_nulls=False)) == levels(kept)


@pytest.mark.parametrize("null_rate", [0.0, 0.2])
def test_rules_are_those_of_the_tables(spark, null_rate):
    _, tables = orders_and_lines(spark, null_rate)
    plain = discover_with_rules(tables, line_up=False)
    found = discover_with_rules(tables.stored(distinct=["lines"]))
    assert levels(found) == levels(plain)
    assert sorted(map(str, found.rules().collect())) == sorted(map(str, plain.rules().collect()))


def test_checked_candidates_are_those_of_the_tables(spark):
    """With all sizes and with what fails; of three columns more fails than of two."""
    _, tables = orders_and_lines(spark, 0.2)
    candidates = [((65536, 65538), (1, 3)), ((1, 3), (65536, 65538)), ((65536, 65537), (1, 0)), ((0, 1), (65537, 65536)),
                  ((131072, 131073), (1, 2)), ((1, 2), (2, 1))]
    asked = spark.createDataFrame(candidates, "dep array<int>, ref array<int>")
    lined = lined_up(tables, asked)
    assert len(lined.lineups) == 1 and lined.lineups[0].has_nulls
    rows = lambda found: sorted(map(str, found[0].collect()))
    assert rows(validated(lined, asked)) == rows(validated(tables, asked)) == rows(validated(lined, asked, refute=False))


def test_shared_and_repeated_rows_are_read_once(spark):
    """260 rows of two tables are 60 in the lineup; combos with its key are not grouped by value."""
    _, tables = orders_and_lines(spark)
    candidates = [((0, 1), (65537, 65536)), ((65536, 65537), (1, 0)), ((65536, 65538), (1, 3)), ((0, 1), (1, 0))]
    pairs = [((0, 1, 2, 3), (65537, 65536, 65539, 65538))]
    lined = lined_up(tables, spark.createDataFrame(pairs, "dep array<int>, ref array<int>"))
    (lineup,) = lined.lineups
    assert lineup.df.count() == 60 and lineup.unique == {0} and not lineup.has_nulls
    combos = side_by_side(lined, [(0, 1), (65537, 65536), (1, 3), (65536, 65538)])
    assert combo_values(lined, combos).count() == 2 * 60 < combo_values(tables, combos).count() == 2 * 260
    alone = _row_by_row(lined, combos, candidates[:3], False)
    assert sorted(combos[m] for m in alone) == [(0, 1), (65537, 65536)]
    # A key is compared with columns in another order, whose rows may hold the same values.
    assert _row_by_row(lined, [*combos, (1, 0)], candidates, False) == []
    sizes = lambda groups: {combos[r.m]: r.n for r in groups.selectExpr("explode(words) w", "n").selectExpr(
        "explode(filter(sequence(0, 62), b -> getbit(w.bits, b) = 1)) m", "n").groupBy("m").agg({"n": "sum"}).toDF("m", "n").collect()}
    assert sizes(combo_groups(lined, combos, candidates=candidates[:3])) == sizes(combo_groups(tables, combos))


def test_tables_are_matched_by_their_heaviest_pairs():
    a, b, c, d = (n << 16 for n in range(4))
    pairs = [(a, b, 9), (a + 1, b + 1, 8), (a, b + 1, 7), (a + 1, c, 6), (a, c + 1, 5), (b, d, 4), (c, d, 1), (c + 1, d + 1, 1)]
    assert matched(pairs, 16) == [[[a, a + 1], [b, b + 1], [c + 1, c], [d + 1, d]]]
    assert matched(pairs[:-1], 16) == [[[a, a + 1], [b, b + 1], [c + 1, c]]]
    assert matched([(a, b, 9), (a, b + 1, 9)], 16) == []


def test_distinct_copies_keep_what_texts_tell_apart(spark):
    numbers = spark.sql("SELECT * FROM VALUES (0D, 1), (-0D, 1), (0D, 1) AS t(d, i)")
    texts = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 1), (NULL, 1), (NULL, 1), ('A', 1) AS t(s, i)")
    long = spark.range(3).selectExpr("repeat('x', 90) AS s", "id DIV 2 AS i")
    stored = TableSet.from_dataframes(spark, {"numbers": numbers, "texts": texts, "long": long}).stored(["numbers", "texts", "long"])
    rows = [sorted(map(str, (r.asDict()["c0"] for r in t.df.collect()))) for t in stored.tables]
    assert rows == [["-0.0", "0.0"], ["A", "None", "a"], ["x" * 90] * 2]
