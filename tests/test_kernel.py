"""Groups, unary results and statistics against brute force on random tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from subsumo import (
    TableSet,
    count_unary_inds,
    discover,
    overlap_histogram,
    partial_unary_inds,
    unary_inds,
    unary_overlaps,
    void_unary_inds,
)
from subsumo.functions.text import LONGEST_PLAIN_KEY, group_key
from subsumo.functions.words import members, slot
from subsumo.operators import groups as kernel
from subsumo.operators.naming import column_name, rendered, rendered_named, rendered_partial, table_name
from subsumo.operators.nary import chunk_combos, combo_groups, combo_sketches, not_refuted
from subsumo.operators.unary import attribute_group_lists, column_groups
from subsumo.plans.stats import column_stats, dataset_stats, table_stats


def random_rows(seed, n_rows, n_columns, n_values, null_rate=0.2):
    rng = random.Random(seed)
    # The first value fills about a third of all cells, and one column is empty.
    draw = lambda: "hot" if rng.random() < 0.33 else f"v{rng.randrange(n_values)}"
    rows = [[None if rng.random() < null_rate else draw() for _ in range(n_columns)] for _ in range(n_rows)]
    for row in rows:
        row[-1] = None
    return rows


def as_table_set(spark, *tables, **options):
    frames = {}
    for i, rows in enumerate(tables):
        schema = ", ".join(f"c{j} string" for j in range(len(rows[0])))
        frames[f"t{i}"] = spark.createDataFrame([tuple(r) for r in rows], schema).repartition(3)
    return TableSet.from_dataframes(spark, frames, **options)


def value_sets(tables, drop_nulls=True):
    """column id -> set of values"""
    sets = {}
    for number, rows in enumerate(tables):
        for j in range(len(rows[0])):
            sets[(number << 16) + j] = {r[j] for r in rows if r[j] is not None or not drop_nulls}
    return sets


DATA = [random_rows(1, 30, 5, 6), random_rows(2, 20, 4, 4, 0.5)]


@pytest.mark.parametrize("drop_nulls", [True, False])
@pytest.mark.parametrize("dense_words", [32, 0])
def test_unary_results(spark, monkeypatch, drop_nulls, dense_words):
    """Both ways of building groups: words as columns, and one word per row for wide schemas."""
    monkeypatch.setattr(kernel, "MAX_DENSE_WORDS", dense_words)
    tables = as_table_set(spark, *DATA)
    sets = value_sets(DATA, drop_nulls)
    inds = {(a, b) for a in sets for b in sets if a != b and sets[a] <= sets[b]}
    found = unary_inds(tables, drop_nulls).collect()
    assert {(r.dep, r.ref) for r in found} == inds and len(found) == len(inds)
    assert all(r.size == len(sets[r.dep]) for r in found)
    proper = {(a, b) for a, b in inds if sets[a]}
    assert count_unary_inds(tables, drop_nulls).first().n == len(proper)
    void = {(r.dep, r.ref) for r in void_unary_inds(tables, drop_nulls).collect()}
    assert void == inds - proper
    shared = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    pairs = unary_overlaps(tables, drop_nulls).collect()
    assert {(r.dep, r.ref): r.overlap for r in pairs} == shared
    assert all(r.size == len(sets[r.dep]) for r in pairs)


def test_many_words(spark, monkeypatch):
    """More members than one word holds."""
    rows = random_rows(3, 12, 70, 3)
    sets = value_sets([rows])
    expected = {(a, b) for a in sets for b in sets if a != b and sets[a] <= sets[b]}
    tables = as_table_set(spark, rows)
    assert {(r.dep, r.ref) for r in unary_inds(tables).collect()} == expected
    monkeypatch.setattr(kernel, "MAX_DENSE_WORDS", 1)
    assert {(r.dep, r.ref) for r in unary_inds(tables).collect()} == expected
    shared = {(r.dep, r.ref): r.overlap for r in unary_overlaps(tables).collect()}
    assert shared == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a != b and sets[a] & sets[b]}


def test_groups(spark):
    tables = as_table_set(spark, *DATA)
    columns_of = defaultdict(list)
    for column, values in sorted(value_sets(DATA).items()):
        for v in values:
            columns_of[v].append(column)
    expected = Counter(tuple(g) for g in columns_of.values())
    assert {tuple(r["columns"]): r.n for r in attribute_group_lists(tables).collect()} == expected
    lists = kernel.inclusion_lists(column_groups(tables)).collect()
    assert len(lists) == sum(len(g) for g in expected)
    assert all(r.dep not in r.refs for r in lists)


def test_words(spark):
    chosen = [0, 5, 62, 63, 130]
    words = Counter()
    for m in chosen:
        k, bit = slot(m)
        words[k] += bit
    row = spark.createDataFrame([([tuple(w) for w in sorted(words.items())],)], "words array<struct<k int, bits bigint>>")
    assert row.select(members("words").alias("m")).first().m == chosen


def test_partial_and_histogram(spark):
    tables = as_table_set(spark, *DATA)
    sets = value_sets(DATA)
    ratio = {
        (a, b): len(sets[a] & sets[b]) / len(sets[a]) for a in sets for b in sets if a != b and sets[a] & sets[b]
    }
    for least in (0.0, 0.5, 0.9):
        rows = partial_unary_inds(tables, least).collect()
        assert {(r.dep, r.ref): r.overlap for r in rows} == {p: pytest.approx(x) for p, x in ratio.items() if x >= least}
    assert partial_unary_inds(tables, max_error=0.5).count() == partial_unary_inds(tables, 0.5).count()
    bucket = lambda x: 1 if x < 0.1 else 2 if x < 0.9 else 3 if x < 0.99 else 4 if x < 1 else 5
    counts = Counter(bucket(x) for x in ratio.values())
    n = [r.n for r in overlap_histogram(tables).collect()]
    assert n == [len(sets) * (len(sets) - 1) - len(ratio)] + [counts[i] for i in range(1, 6)]
    assert sum(n) == len(sets) * (len(sets) - 1)


def test_long_values(spark):
    """Digests stand for whole texts: a difference at the very end counts."""
    base = "x" * 5000
    rows = [[base + "a", base + "a"], [base + "b", base + "c"], ["short", "short"]]
    expected = {(0, 1): 2, (1, 0): 2}
    for digest in (True, False):
        tables = as_table_set(spark, rows, digest_long=digest)
        assert {(r.dep, r.ref): r.overlap for r in unary_overlaps(tables).collect()} == expected
    assert {(r.dep, r.ref): r.overlap for r in unary_overlaps(tables.stored()).collect()} == expected


def test_doubles_are_not_rounded(spark):
    df = spark.sql("SELECT * FROM VALUES (0.12345678901D, 0.12345678902D), (1e300D, 1e300D) AS t(a, b)")
    rows = unary_overlaps(TableSet.from_dataframes(spark, {"t": df})).collect()
    assert {(r.dep, r.ref): (r.size, r.overlap) for r in rows} == {(0, 1): (2, 1), (1, 0): (2, 1)}


def test_values_are_text(spark):
    df = spark.sql("SELECT 1 AS i, 1.0D AS d, '1' AS s, true AS b, 'true' AS t, X'31' AS x, '31' AS h")
    found = {(r.dep, r.ref) for r in unary_inds(TableSet.from_dataframes(spark, {"t": df})).collect()}
    assert found == {(0, 2), (2, 0), (3, 4), (4, 3), (5, 6), (6, 5)}


def test_untyped_null_columns_are_void(spark):
    tables = TableSet.from_dataframes(spark, {"t": spark.sql("SELECT 1 AS a, NULL AS b")})
    assert {(r.dep, r.ref, r.size) for r in unary_inds(tables).collect()} == {(1, 0, 0)}
    assert {(r.dep, r.ref) for r in unary_inds(tables.stored()).collect()} == {(1, 0)}


def test_null_string_of_typed_tables(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 'a'), ('-', 'b') AS t(x, y)")
    tables = TableSet.from_dataframes(spark, {"t": df}, null_string="-")
    assert {(r.dep, r.ref) for r in unary_inds(tables).collect()} == {(0, 1)}


def test_max_columns(spark):
    tables = as_table_set(spark, *DATA, max_columns=2)
    assert [t.width for t in tables.tables] == [2, 2]


def test_statistics(spark, monkeypatch):
    tables = as_table_set(spark, *DATA)
    assert {r.table_name: (r.width, r.height) for r in table_stats(tables).collect()} == {"t0": (5, 30), "t1": (4, 20)}
    assert tuple(dataset_stats(tables).first()) == (9, 50)
    sets = value_sets(DATA)
    nulls = {(n << 16) + j: sum(r[j] is None for r in rows) for n, rows in enumerate(DATA) for j in range(len(rows[0]))}
    rows = column_stats(tables).collect()
    assert {r.column_id: (r.size, r.nulls) for r in rows} == {c: (len(sets[c]), nulls[c]) for c in sets}
    combos = [(0, 1), (1, 0), (65536, 65538), (4, 2)]
    any_null = lambda combo: sum(any(r[c & 65535] is None for c in combo) for r in DATA[combo[0] >> 16])
    complete = lambda combo: {
        t for r in DATA[combo[0] >> 16] if None not in (t := tuple(r[c & 65535] for c in combo))
    }
    for dense_words in (32, 0):
        monkeypatch.setattr(kernel, "MAX_DENSE_WORDS", dense_words)
        found = kernel.member_stats(combo_groups(tables, combos, count_nulls=True)).collect()
        assert {r.m: (r.size, r.nulls) for r in found} == {m: (len(complete(c)), any_null(c)) for m, c in enumerate(combos)}
        rows = column_stats(tables.stored()).collect()
        assert {r.column_id: (r.size, r.nulls) for r in rows} == {c: (len(sets[c]), nulls[c]) for c in sets}


@pytest.mark.parametrize("drop_nulls", [True, False])
def test_bitmaps_refute_only_what_fails(spark, drop_nulls):
    """A part of a table is never refuted; of other parts next to all are, whatever the number of values is."""
    rng = random.Random(6)
    draw = lambda: None if rng.random() < 0.1 else rng.randrange(300)
    rows = [(i % 4000, draw(), i % 3) for i in range(6000)]
    whole = spark.createDataFrame(rows, "a int, b int, c int")
    few = whole.where("a % 7 = 1")
    tables = TableSet.from_dataframes(spark, {"whole": whole, "few": few, "other": whole.withColumn("a", F.expr("a + 60"))})
    candidates = [((n << 16, (n << 16) + 1), (m << 16, (m << 16) + 1)) for n in range(3) for m in range(3) if n != m]
    candidates += [((1 << 16, (1 << 16) + 2), (0, 2)), ((0, 2), ((1 << 16), (1 << 16) + 2)), ((0, 2), ((2 << 16), (2 << 16) + 2))]
    data = [{tuple(r) for r in t.df.collect()} for t in tables.tables]

    def values(combo):
        found = {tuple(r[c & 65535] for c in combo) for r in data[combo[0] >> 16]}
        return {t for t in found if None not in t} if drop_nulls else found

    left = not_refuted(tables, candidates, drop_nulls)
    assert left == [(d, r) for d, r in candidates if values(d) <= values(r)]
    assert combo_sketches(tables, chunk_combos(candidates), drop_nulls).shape == (len(chunk_combos(candidates)), 256)


def test_bitmaps_of_void_combos(spark):
    tables = TableSet.from_dataframes(spark, {n: spark.sql("SELECT CAST(NULL AS INT) AS a, 1 AS b") for n in ("x", "y")})
    candidates = [((0, 1), (65536, 65537)), ((1, 0), (65537, 65536))]
    assert not_refuted(tables, candidates) == candidates


def test_names(spark):
    tables = as_table_set(spark, *DATA)
    df = spark.sql("SELECT array(0, 1) AS dep, array(65536, 65538) AS ref, 0.5D AS overlap")
    assert df.select(rendered(tables)).first()[0] == "t0[0, 1] ⊆ t1[0, 2]"
    assert df.select(rendered_partial(tables, "dep", "ref")).first()[0] == "t0[0, 1] ⊆ t1[0, 2] (overlap=0.5)"
    assert rendered_named(df, tables).first().text == "[t0.c0, t0.c1] ⊆ [t1.c0, t1.c2]"
    empty = spark.sql("SELECT cast(array() AS array<int>) AS dep, cast(array() AS array<int>) AS ref")
    assert empty.select(rendered(tables)).first()[0] == "[] ⊆ []"
    unknown = spark.sql("SELECT 131073 AS a, 77 AS b")
    names = [table_name(tables, F.col("a")), column_name(tables, F.col("a")), column_name(tables, F.col("b"))]
    assert list(unknown.select(*names).first()) == ["(unknown table with ID 196607)", "column1", "(unknown column with index 77)"]


def test_count_only(spark):
    found = discover(as_table_set(spark, *DATA), count_only=True)
    assert found.num_discovered == count_unary_inds(found.tables).first().n
    assert len(found.levels) == 1


def test_digest_keys_cannot_meet_short_values(spark):
    """Around the longest plain key, and a value that is another one's digest key."""
    limit = LONGEST_PLAIN_KEY
    texts = ["x" * n for n in range(limit - 2, limit + 3)] + ["ä" * (limit // 2), "ä" * (limit // 2 + 1)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    keyed = df.select("t", group_key(F.col("t"), df.schema["t"].dataType).alias("k")).collect()
    for row in keyed:
        assert (row.k == row.t) == (len(row.t.encode()) <= limit)
        assert row.k == row.t or len(row.k) > limit
    assert len({r.k for r in keyed}) == len(texts)
