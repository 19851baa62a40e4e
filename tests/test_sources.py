"""Files, charsets, dialects, ragged lines, catalog tables."""

import gzip

import pytest
from pyspark.sql import functions as F

from subsumo import Dialect, TableSet, csv_tables, unary_inds
from subsumo.operators.cells import cell_values, tuples
from subsumo.operators.sampling import complete_tuples, key_sample, round_robin_sample
from subsumo.sources.csv import apply_width_policy, first_line_widths, parse_lines, table_widths, width_violations
from subsumo.sources.lines import list_files, parse_encoding, scan_lines


def values(df):
    return sorted(r.value for r in df.select("value").collect())


def test_lines_are_tagged(spark, files):
    one = scan_lines(spark, files["letters.csv"], 65535)
    two = scan_lines(spark, files["letters-ext.csv"], 131071)
    counts = dict(one.unionByName(two).groupBy("table_id").count().collect())
    assert counts == {65535: 5, 131071: 6}


def test_ids_from_paths(spark, files):
    lines = scan_lines(spark, [files["letters.csv"], files["letters-ext.csv"]])
    counts = lines.groupBy("table_id", "path").count().collect()
    assert sorted(r["count"] for r in counts) == [5, 6]
    again = scan_lines(spark, files["letters.csv"]).select("table_id").distinct().collect()
    assert [r.table_id for r in again] == [r.table_id for r in counts if r["count"] == 5]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a.csv").write_text("a\n")
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "sub" / "b.csv").write_text("b\n")
    (tmp_path / "sub" / "deep" / "c.tsv").write_text("c\n")
    return str(tmp_path)


def test_nested_folders(spark, tree):
    assert values(scan_lines(spark, tree, 1, recursive=True)) == ["a", "b", "c"]
    assert values(scan_lines(spark, tree, 1, recursive=True, name_regex=r".*\.csv")) == ["a", "b"]


def test_file_lists(spark, tree):
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(list_files(spark, tree)) == ["a.csv", "b.csv", "c.tsv"]
    assert names(list_files(spark, tree, max_depth=1)) == ["a.csv"]
    assert names(list_files(spark, tree, max_depth=2)) == ["a.csv", "b.csv"]
    assert names(list_files(spark, tree, name_regex=r"[bc]\..*")) == ["b.csv", "c.tsv"]
    assert names(list_files(spark, tree, glob="*.tsv")) == ["c.tsv"]


def test_compressed_lines(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("1;2\n3;4\n")
    tables = csv_tables(spark, {"x": str(tmp_path / "x.csv.gz")}, spread=2)
    assert tables.tables[0].width == 2
    assert tables.tables[0].text().count() == 2


@pytest.mark.parametrize("charset", ["ISO-8859-1", "windows-1252"])
def test_charsets(spark, tmp_path, charset):
    (tmp_path / "x.txt").write_bytes("äöü\nß\n".encode(charset))
    assert values(scan_lines(spark, str(tmp_path / "x.txt"), 1, encoding=charset)) == ["ß", "äöü"]


def test_charset_per_table(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("ä;b\n".encode("ISO-8859-1"))
    (tmp_path / "y.txt").write_bytes("ä;c\n".encode("UTF-8"))
    paths = {"x": str(tmp_path / "x.txt"), "y": str(tmp_path / "y.txt")}
    tables = csv_tables(spark, paths, encoding={"x": "ISO-8859-1"})
    assert {(r.dep, r.ref) for r in unary_inds(tables).collect()} == {(0, 1 << 16), (1 << 16, 0)}


def test_byte_order_mark(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"\xef\xbb\xbfa\nb\n")
    assert values(scan_lines(spark, str(tmp_path / "x.txt"), 1)) == ["a", "b"]


@pytest.mark.parametrize("charset,name", [
    ("gbk", "GBK"), ("shift_jis", "Shift_JIS"), ("euc_jp", "EUC-JP"), ("big5", "Big5"), ("gb18030", "GB18030"),
    ("utf-16-le", "UTF-16LE"), ("utf-16-be", "utf_16be"), ("utf-32-le", "UTF-32LE"), ("utf-32-be", "UTF32-BE"),
])
@pytest.mark.parametrize("whole", [False, True])
def test_charsets_of_more_bytes(spark, tmp_path, charset, name, whole):
    lines = ["漢字;a", "", "日本;b", "x" * 70_000 + ";c"]
    (tmp_path / "x.txt").write_bytes(("\r\n".join(lines) + "\n").encode(charset))
    assert values(scan_lines(spark, str(tmp_path), 1, encoding=name, whole_files=whole)) == sorted(lines)
    tables = csv_tables(spark, {"x": str(tmp_path)}, encoding=name, policy="drop", widths={"x": 2}, whole_files=whole)
    assert sorted(r["c1"] for r in tables.tables[0].text().collect()) == ["a", "b", "c"]


def test_marks_tell_the_order_of_bytes(spark, tmp_path):
    for order in ("le", "be"):
        (tmp_path / order).write_bytes(("\ufeff" + "ä;1\nß;2").encode(f"utf-16-{order}"))
        assert values(scan_lines(spark, str(tmp_path / order), 1, encoding="UTF-16", whole_files=True)) == ["ß;2", "ä;1"]
        assert values(scan_lines(spark, str(tmp_path / order), 1, encoding=f"UTF-16{order}")) == ["ß;2", "ä;1"]
    with pytest.raises(ValueError):
        scan_lines(spark, str(tmp_path), 1, encoding="UTF-16")


def test_newline_bytes_across_characters(spark, tmp_path):
    """The bytes of a newline, half in one character and half in the next: refused, not misread."""
    (tmp_path / "x").write_bytes("\u0a41\u3000x\ny".encode("utf-16-be") + "\u3000\u0a41\u0a00".encode("utf-16-be"))
    (tmp_path / "y").write_bytes("\u0a41\u3000x\ny".encode("utf-16-le"))
    with pytest.raises(Exception, match="whole files"):
        scan_lines(spark, str(tmp_path / "y"), 1, encoding="UTF-16LE").collect()
    with pytest.raises(Exception, match="whole files"):
        scan_lines(spark, str(tmp_path / "x"), 1, encoding="UTF-16BE").collect()
    assert values(scan_lines(spark, str(tmp_path / "y"), 1, encoding="UTF-16LE", whole_files=True)) == ["y", "\u0a41\u3000x"]


def test_malformed_bytes_and_settings(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"a\x81\nb\n")
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert values(scan_lines(spark, str(tmp_path), 1, encoding="Shift_JIS")) == ["a\ufffd", "b"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_encoding_text():
    assert parse_encoding("UTF_8:UTF-8") == (True, "UTF-8")
    assert parse_encoding("NONE:ISO-8859-1") == (False, "ISO-8859-1")
    assert parse_encoding("") == parse_encoding(None) == (False, "UTF-8")


def rows_to_lines(spark, lines):
    rows = [(1, "p", 0, i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "table_id int, path string, block_start long, row_in_block long, value string")


QUOTED = Dialect(separator=",", quote='"')
ESCAPED = Dialect(separator=",", quote='"', escape="\\")


@pytest.mark.parametrize(
    "dialect, line, fields",
    [
        (Dialect(), "a;;b;", ["a", "", "b", ""]),
        (Dialect(), "", [""]),
        (Dialect(), '"a;b"', ['"a', 'b"']),
        (Dialect(separator="|"), "a|b", ["a", "b"]),
        (Dialect(separator=".", ignore_leading_whitespace=True), "a. b ", ["a", " b "]),
        (QUOTED, '"a,b",c', ["a,b", "c"]),
        (QUOTED, '"say ""hi""",', ['say "hi"', ""]),
        (QUOTED, '"",x', ["", "x"]),
        (QUOTED, ",,", ["", "", ""]),
        (QUOTED, 'x,ab"c,d"ef,g', ["x", 'ab"c,d"ef', "g"]),
        (QUOTED, 'x,"ab"cd,e"f"', ["x", 'ab"cd', 'e"f']),
        (QUOTED, 'a"b"c', ['a"b"c']),
        (QUOTED, '"open', None),
        (QUOTED, 'a,"b""', None),
        (ESCAPED, '"a\\",b",c\\d', ['a",b', "cd"]),
        (ESCAPED, '"a\\\\b\\c"', ["a\\bc"]),
        (Dialect(separator=",", quote='"', strict_quotes=True), 'x"a"y, "b" ,c', ["a", "b", ""]),
        (Dialect(separator=",", quote='"', ignore_leading_whitespace=True), 'a,  "b", c', ["a", "b", " c"]),
        (Dialect(separator=",", quote='"'), 'a,  "b"', ["a", '  "b']),
        (Dialect(separator=",", quote="'"), "'a\"','b", None),
        (Dialect(separator=",", quote="'"), "'a\"',\"b", ['a"', '"b']),
    ],
)
def test_dialects(spark, dialect, line, fields):
    assert parse_lines(rows_to_lines(spark, [line]), dialect).first().f == fields


def test_null_string(spark):
    parsed = parse_lines(rows_to_lines(spark, ["a;N;"]), Dialect(), "N")
    assert parsed.first().f == ["a", None, ""]


RAGGED = ["1;2;3", "1;2", "1;2;3;4", "5;6;7"]


def test_widths(spark):
    parsed = parse_lines(rows_to_lines(spark, RAGGED))
    assert first_line_widths(parsed).first().width == 3
    assert table_widths(parsed).first().width == 4
    assert width_violations(parsed, {1: 3}).first().lines == 2


def test_width_policies(spark):
    parsed = parse_lines(rows_to_lines(spark, RAGGED))
    kept = lambda policy: apply_width_policy(parsed, {1: 3}, policy).select("f").collect()
    assert len(kept("drop")) == 2
    assert len(kept("warn")) == 4
    for policy in ("fail", "fail_overlong"):
        with pytest.raises(Exception, match="wrong number of fields"):
            kept(policy)
    short = parse_lines(rows_to_lines(spark, RAGGED[:2]))
    assert apply_width_policy(short, {1: 3}, "fail_overlong").select("f").count() == 2
    with pytest.raises(ValueError):
        kept("ignore")


def test_unparsable_lines(spark):
    parsed = parse_lines(rows_to_lines(spark, ["a,b", '"a,b']), QUOTED)
    assert apply_width_policy(parsed, {1: 2}, "drop").count() == 1
    with pytest.raises(Exception, match="wrong number of fields"):
        apply_width_policy(parsed, {1: 2}, "fail").select("f").collect()


def test_ragged_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n".join(RAGGED))
    dropped = csv_tables(spark, {"x": str(tmp_path / "x.csv")}, policy="drop")
    assert [r.c2 for r in dropped.tables[0].text().collect()] == ["3", "7"]
    declared = csv_tables(spark, {"x": str(tmp_path / "x.csv")}, policy="drop", widths={"x": 2}, max_columns=1)
    assert [tuple(r) for r in declared.tables[0].text().collect()] == [("1",)]
    kept = csv_tables(spark, {"x": str(tmp_path / "x.csv")}, policy="warn", column_names={"x": ["a", "b", "c", "d"]})
    assert kept.tables[0].column_names == ["a", "b", "c", "d"]
    assert kept.tables[0].text().count() == 4


def test_catalog_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.range(3).selectExpr("id AS small").write.mode("overwrite").saveAsTable("shop.a")
    spark.range(5).selectExpr("id AS big").write.mode("overwrite").saveAsTable("shop.b")
    tables = TableSet.from_catalog(spark, "shop")
    assert [t.name for t in tables.tables] == ["a", "b"]
    assert [(r.dep, r.ref) for r in unary_inds(tables).collect()] == [(0, 1 << 16)]


def test_parquet_paths(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    assert len(TableSet.from_paths(spark, {"a": str(tmp_path / "a")}).columns) == 1


def test_registry(spark, files):
    tables = csv_tables(spark, {"l": files["letters.csv"], "x": files["letters-ext.csv"]}, Dialect(separator=","))
    rows = [tuple(r) for r in tables.registry().orderBy("column_id").collect()]
    assert rows[0] == (0, 65535, "l", 0, "column1")
    assert rows[-1] == (65540, 131071, "x", 4, "column5")
    assert tables.column_id("x", "column2") == tables.column_id("x", 1) == 65537


def test_complex_columns_are_refused(spark):
    with pytest.raises(ValueError, match="maps"):
        TableSet.from_dataframes(spark, {"t": spark.sql("SELECT map(1, 2) AS a")})


def test_arrays_have_a_text(spark):
    rows = "SELECT explode(array(array('a, b'), array('a', 'b'), array('a', null), null)) AS a"
    tables = TableSet.from_dataframes(spark, {"t": spark.sql(rows)})
    assert sorted(r.v for r in cell_values(tables).collect()) == ['["a","b"]', '["a",null]', '["a, b"]']


def test_round_robin_sample(spark):
    df = spark.range(0, 1000, 1, 2)
    # Slots are counted per task: 500 rows each.
    sampled = [r.id for r in round_robin_sample(df, 30).collect()]
    assert len(sampled) == 300
    assert sampled[:4] == [0, 3, 6, 10]
    assert [r.id for r in key_sample(df, F.col("id"), 30).collect()][:4] == [0, 3, 6, 10]
    for percent in (0, 100):
        with pytest.raises(ValueError):
            round_robin_sample(df, percent)


def test_sampled_tables_stay_the_same(spark):
    tables = TableSet.from_dataframes(spark, {"t": spark.range(0, 1000, 1, 1)}, sample_percent=10)
    assert tables.tables[0].text().count() == 100
    assert unary_inds(tables).count() == 0


def test_complete_tuples(spark):
    df = spark.sql("SELECT explode(array(array('a','b'), array('a',''), array('a',null))) AS f")
    assert [r.f for r in complete_tuples(df).collect()] == [["a", "b"]]


def test_width_comes_from_the_first_file(spark, tmp_path):
    folder = tmp_path / "a table"
    folder.mkdir()
    (folder / "part 2.csv").write_text("1;2;3\n" * 50)
    (folder / "part 1.csv").write_text("1;2\n3;4\n")
    (folder / "part 3.csv").write_text("5;6\n")
    tables = csv_tables(spark, {"x": str(folder)}, policy="drop")
    assert sorted(tuple(r) for r in tables.tables[0].text().collect()) == [("1", "2"), ("3", "4"), ("5", "6")]


def test_empty_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    (tmp_path / "y.csv").write_text("1\n")
    tables = csv_tables(spark, {"x": str(tmp_path / "x.csv"), "y": str(tmp_path / "y.csv")})
    assert [t.width for t in tables.tables] == [0, 1]
    assert unary_inds(tables).count() == 0


def test_carriage_returns(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a;b\rc;d\r\ne;f;g\n")
    assert values(scan_lines(spark, str(tmp_path / "x.csv"), 1)) == ["a;b\rc;d", "e;f;g"]


def test_overlong_lines_fail_against_the_first_line(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1;2\n1\n1;2;3\n")
    tables = csv_tables(spark, {"x": str(tmp_path / "x.csv")}, policy="fail_overlong")
    assert tables.tables[0].width == 2
    with pytest.raises(Exception, match="wrong number of fields"):
        tables.tables[0].text().collect()


def test_dropped_lines_are_counted(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1;2;3\n1;2\n1;2;3\n1\n")
    tables = csv_tables(spark, {"x": str(tmp_path / "x.csv")}, policy="drop")
    assert tables.tables[0].text().count() == 2
    assert [tuple(r) for r in tables.width_violations.collect()] == [(65535, 2)]


def test_samples_are_drawn_from_lines(spark, tmp_path):
    """Ragged lines take part in the draw, so the sample does not depend on the policy."""
    (tmp_path / "x.csv").write_text("".join("1;2\n" if i % 2 else "1;2;3\n" for i in range(100)))
    tables = csv_tables(spark, {"x": str(tmp_path / "x.csv")}, policy="drop", widths={"x": 3}, sample_percent=50)
    assert tables.tables[0].text().count() == 50


def test_no_columns_at_all(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    tables = csv_tables(spark, {"x": str(tmp_path / "x.csv")})
    assert unary_inds(tables).count() == cell_values(tables).count() == tuples(tables).count() == 0
    none = TableSet.from_dataframes(spark, {"t": spark.range(3)}, max_columns=0)
    assert unary_inds(none).count() == 0


def test_repeated_names(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS a UNION ALL SELECT 2, 2")
    tables = TableSet.from_dataframes(spark, {"t": df})
    assert [t.column_names for t in tables.tables] == [["a", "a"]]
    assert [(r.dep, r.ref) for r in unary_inds(tables).collect()] == [(1, 0)]


def test_ids_fit_their_type(spark):
    frames = {name: spark.range(1) for name in "abcde"}
    with pytest.raises(ValueError, match="31 bits"):
        TableSet.from_dataframes(spark, frames, column_bits=30)


def test_stored_tables_keep_their_texts(spark):
    long = "x" * 100
    tables = TableSet.from_dataframes(spark, {"t": spark.createDataFrame([(long,), ("y",)], "a string")}).stored()
    assert sorted(r.v for r in cell_values(tables).collect()) == [long, "y"]
    assert [r.f for r in tuples(tables.stored()).collect()].count([long]) == 1
    both = {"t": spark.createDataFrame([(long,)], "a string"), "u": spark.createDataFrame([(long,), ("y",)], "a string")}
    assert [(r.dep, r.ref) for r in unary_inds(TableSet.from_dataframes(spark, both).stored()).collect()] == [(0, 65536)]


def test_tables_of_chosen_files(spark, tree):
    tables = csv_tables(spark, {"t": tree}, max_depth=2, name_regex=r".*\.csv")
    assert sorted(r.c0 for r in tables.tables[0].text().collect()) == ["a", "b"]
    assert csv_tables(spark, {"t": tree}, recursive=True, glob="*.tsv").tables[0].text().first().c0 == "c"


def test_long_quoted_fields(spark):
    text = 'say ""hi"", ' * 20000
    fields = parse_lines(rows_to_lines(spark, [f'x,"{text}",y']), QUOTED).first().f
    assert fields == ["x", text.replace('""', '"'), "y"]


# --- headers ------------------------------------------------------------------------


def named_rows(tables):
    return {t.name: (t.column_names, sorted(map(tuple, t.df.select(*t.fields).collect()))) for t in tables.tables}


def test_headers(spark, tmp_path):
    """Only the first line of each file goes, also if data lines are equal to it; files may hold nothing else."""
    one = tmp_path / "one"
    one.mkdir()
    (one / "a.csv").write_text("x;y\n1;2\nx;y\n3;4\n")
    (one / "b.csv").write_text("x;y\n5;6\nx;y\n")
    (one / "c.csv").write_text("x;y\n")
    (one / "d.csv").write_text("")
    (tmp_path / "two.csv").write_bytes("\ufeffÄ;Ä;\r\n1;2;3\r\n".encode())
    (tmp_path / "none.csv").write_text("")
    paths = {"one": str(one), "two": str(tmp_path / "two.csv"), "none": str(tmp_path / "none.csv")}
    rows = [("1", "2"), ("3", "4"), ("5", "6"), ("x", "y"), ("x", "y")]
    expected = {"one": (["x", "y"], rows), "two": (["Ä", "Ä", ""], [("1", "2", "3")]), "none": ([], [])}
    for policy in ("fail", "warn"):
        tables = csv_tables(spark, paths, header=True, policy=policy)
        found = named_rows(tables)
        assert {n: found[n] for n in ("one", "two")} == {n: expected[n] for n in ("one", "two")}
        assert found["none"][0] == []
    assert [r.name for r in tables.registry().orderBy("column_id").collect()] == ["x", "y", "Ä", "Ä", ""]
    renamed = csv_tables(spark, paths, header=True, column_names={"one": ["p", "q"]}, max_columns=1)
    assert {n: names for n, (names, _) in named_rows(renamed).items()} == {"one": ["p"], "two": ["Ä"], "none": []}


def test_headers_of_many_blocks(spark, tmp_path):
    """Blocks within a file have no header; tasks may read blocks of several files."""
    folder = tmp_path / "blocks"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.csv").write_text("n;text\n" + "".join(f"{j};{'t' * (j % 50)}\n" for j in range(i * 500, i * 500 + 500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("1000b", "30000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            (names, rows), = named_rows(csv_tables(spark, {"t": str(folder)}, header=True)).values()
            assert names == ["n", "text"] and sorted(int(n) for n, _ in rows) == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_headers_in_quotes_and_samples(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('"a,b","c"\n' + "".join(f'"{i}","x,{i}"\n' for i in range(200)))
    dialect = Dialect(separator=",", quote='"')
    (names, rows), = named_rows(csv_tables(spark, {"t": str(path)}, dialect, header=True, sample_percent=50)).values()
    assert names == ["a,b", "c"] and len(rows) == 100 and all(b == f"x,{a}" for a, b in rows)
    (names, rows), = named_rows(csv_tables(spark, {"t": str(path)}, dialect, header=True, whole_files=True)).values()
    assert names == ["a,b", "c"] and len(rows) == 200
    path.write_text('"never closed\n1,2\n')
    with pytest.raises(ValueError, match="quoted.csv"):
        csv_tables(spark, {"t": str(path)}, dialect, header=True)
    path.write_text("a,b\n1,2,3\n4\n")
    kept = csv_tables(spark, {"t": str(path)}, dialect, header=True, policy="warn")
    assert named_rows(kept)["t"] == (["a", "b", "column3"], [("1", "2", "3"), ("4", None, None)])
    assert named_rows(csv_tables(spark, {"t": str(path)}, dialect, header=True, policy="drop"))["t"] == (["a", "b"], [])


@pytest.mark.parametrize("name", ["charset_multibyte_lines", "charset_utf16_lines", "charset_lines"])
def test_encoded_documents_are_written_by_all_tasks(spark, monkeypatch, name):
    from checks import registry

    rows = [(i, f"a text\n{i}", "en", "web", 8) for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    monkeypatch.setattr(registry, "load", lambda *_: {"documents": documents})
    read = registry.QUERIES[name].run(spark, "")
    assert len(read.inputFiles()) == 4
    assert sorted(int(r["doc_id"]) for r in read.collect()) == list(range(40))
