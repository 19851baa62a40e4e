"""Delimited files: one line is one record, all values are text, widths are discovered.

Lines are cut by regular expressions on columns: Spark's CSV reader would turn an unquoted
empty field into null, while an empty text is a value here.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsumo.operators.cells import union_all
from subsumo.operators.sampling import round_robin_sample
from subsumo.session import materialize
from subsumo.sources.lines import scan_lines, without_first_lines
from subsumo.sources.tables import Table, TableSet

POLICIES = ("fail", "drop", "fail_overlong", "warn")


@dataclass(frozen=True)
class Dialect:
    """How a line is cut into fields. Without ``quote`` and ``escape`` such characters are data."""

    separator: str = ";"
    quote: str | None = None
    escape: str | None = None
    strict_quotes: bool = False
    ignore_leading_whitespace: bool = False

    @property
    def is_plain(self) -> bool:
        return not (self.quote or self.escape)


def parse_lines(lines: DataFrame, dialect: Dialect = Dialect(), null_string: str | None = None) -> DataFrame:
    """Adds ``f array<string>`` and its ``width``; both are null where the line cannot be parsed."""
    if dialect.is_plain:
        fields = F.split("value", _java_quoted(dialect.separator), -1)
        # From the line itself, so that a filter on the width does not split the line again.
        separator = F.lit(dialect.separator)
        rest = F.octet_length(F.replace(F.col("value"), separator, F.lit("")))
        width = ((F.octet_length("value") - rest) / F.octet_length(separator)).cast("int") + 1
        return lines.withColumns({"f": map_nulls(fields, null_string), "width": width})
    fields = _quoted_fields(F.col("value"), dialect)
    return lines.withColumns({"f": map_nulls(fields, null_string), "width": F.when(fields.isNotNull(), F.size(fields))})


def map_nulls(fields: Column, null_string: str | None) -> Column:
    if null_string is None:
        return fields
    return F.transform(fields, lambda x: F.when(x != F.lit(null_string), x))


def _java_quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _quoted_fields(line: Column, dialect: Dialect) -> Column:
    """The fields of a line, or null if it ends inside quotes.

    Quotes protect separators, wherever in a field they stand. A quote at a field's border
    is syntax, one amid its text is text; doubled it is one quote. Escapes protect the
    next character inside quotes and vanish elsewhere. With strict quotes, text outside
    quotes is ignored. White space is only ignored in front of a quote."""
    separator, quote = (re.escape(dialect.separator), re.escape(dialect.quote) if dialect.quote else None)
    escape = re.escape(dialect.escape) if dialect.escape and dialect.escape != dialect.quote else None
    if quote:
        # Possessive throughout: a long text is matched in a loop and never tried again.
        body = f"[^{quote}{escape or ''}]*+(?:(?:{quote}{quote}{f'|{escape}.' if escape else ''})[^{quote}{escape or ''}]*+)*+"
        field = f"(?:{quote}{body}{quote}|(?!{separator})[^{quote}])*+"
    else:
        field = f"(?:(?!{separator}).)*+"
    # With a separator in front every field is a match of its own, empty ones too.
    whole = F.concat(F.lit(dialect.separator), line)
    raw = F.regexp_extract_all(whole, F.lit(f"(?s){separator}({field})"), F.lit(1))
    units = "|".join([f"{quote}({quote})"] * bool(quote) + [f"{escape}(.?)"] * bool(escape))
    kept = "".join(f"${i + 1}" for i in range(units.count("(")))

    def plain(text: Column) -> Column:
        return F.regexp_replace(text, f"(?s){units}", kept)

    def clean(text: Column) -> Column:
        if quote and dialect.strict_quotes:
            inside = F.regexp_extract_all(text, F.lit(f"(?s){quote}({body}){quote}"), F.lit(1))
            return F.array_join(F.transform(inside, plain), "")
        if quote:
            blank = r"\s*" if dialect.ignore_leading_whitespace else ""
            text = F.regexp_replace(text, f"(?s)^{blank}{quote}|{quote}$", "")
        return plain(text)

    return F.when(whole.rlike(f"(?s)^(?:{separator}{field})*+$"), F.transform(raw, clean))


# --- widths -------------------------------------------------------------------------


def first_line_widths(parsed: DataFrame) -> DataFrame:
    """(table_id, width): fields of the first parsable line of a table's first file.

    Only the first block of a file can hold its first line."""
    position = F.struct("path", "block_start", "row_in_block")
    return parsed.where(F.col("width").isNotNull()).groupBy("table_id").agg(F.min_by("width", position).alias("width"))


def header_names(parsed: DataFrame) -> DataFrame:
    """(table_id, path, names): the fields of the first line of a table's first file; null if it cannot be parsed."""
    position = F.struct("path", "block_start", "row_in_block")
    first = F.min_by(F.struct("path", F.col("f").alias("names")), position)
    return parsed.groupBy("table_id").agg(first.alias("first")).select("table_id", "first.*")


def table_widths(parsed: DataFrame) -> DataFrame:
    """(table_id, width): the most fields any line has."""
    return parsed.groupBy("table_id").agg(F.max("width").alias("width"))


def apply_width_policy(parsed: DataFrame, widths: Mapping[int, int], policy: str = "fail") -> DataFrame:
    """What happens to lines without exactly the expected number of fields.

    drop: they are left out; fail: the job fails; fail_overlong: only longer ones fail;
    warn: they are kept (see :func:`width_violations`). Unparsable lines count as wrong."""
    if policy not in POLICIES:
        raise ValueError(f"unknown width policy {policy!r}; choose from {POLICIES}")
    expected = _expected(widths)
    if policy == "drop":
        return parsed.where(F.col("width") == expected)
    if policy == "warn":
        return parsed.where(F.col("width").isNotNull())
    bad = F.col("width") > expected if policy == "fail_overlong" else F.col("width") != expected
    message = F.concat(F.lit("wrong number of fields in "), F.col("path"), F.lit(": "), F.col("value"))
    return parsed.withColumn("f", F.when(F.col("width").isNull() | bad, F.raise_error(message)).otherwise(F.col("f")))


def width_violations(parsed: DataFrame, widths: Mapping[int, int]) -> DataFrame:
    """(table_id, lines): how many lines of each table have another width than expected."""
    wrong = F.col("width").isNull() | (F.col("width") != _expected(widths))
    return parsed.where(wrong).groupBy("table_id").agg(F.count(F.lit(1)).alias("lines"))


def _expected(widths: Mapping[int, int]) -> Column:
    entries = [x for table_id, width in widths.items() for x in (F.lit(table_id), F.lit(width))]
    return F.create_map(*entries)[F.col("table_id")]


# --- tables -------------------------------------------------------------------------


def csv_tables(
    spark: SparkSession,
    paths: Mapping[str, str | list[str]],
    dialect: Dialect = Dialect(),
    null_string: str | None = None,
    policy: str = "fail",
    widths: Mapping[str, int] | None = None,
    column_names: Mapping[str, list[str]] | None = None,
    encoding: str | Mapping[str, str] = "UTF-8",
    strip_bom: bool = True,
    max_columns: int = -1,
    sample_percent: int = -1,
    column_bits: int = 16,
    recursive: bool = False,
    digest_long: bool = True,
    spread: int | None = None,
    name_regex: str | None = None,
    glob: str | None = None,
    max_depth: int | None = None,
    whole_files: bool = False,
    header: bool = False,
) -> TableSet:
    """Named delimited files as a table set. Columns are called column1, column2, … unless named.

    Widths that are not declared are those of the first parsable line of a table's first
    file by path (``warn``: of its widest line). Lines with another width are counted by
    ``TableSet.width_violations`` whatever the policy is. Compressed files come as one task
    each; ``spread`` deals their rows to that many. Files are chosen as in ``scan_lines``.

    With ``header`` the first line of every file is no data: that of a table's first file by path
    names its columns, unless ``column_names`` does, and declares its width, unless ``widths`` does.
    Columns beyond the names are called as without one; an empty name stays empty. Files of
    a table may have headers of their own order; fields go by place. A table without a line has no column."""
    if policy not in POLICIES:
        raise ValueError(f"unknown width policy {policy!r}; choose from {POLICIES}")
    mask = (1 << column_bits) - 1
    numbered = {name: (number << column_bits) | mask for number, name in enumerate(paths)}

    def scanned(name: str, heads_only: bool = False) -> DataFrame:
        charset = encoding if isinstance(encoding, str) else encoding.get(name, "UTF-8")
        return scan_lines(
            spark, paths[name], numbered[name], charset, strip_bom, recursive, name_regex, glob, max_depth, heads_only, whole_files
        )

    names_of = dict(column_names or {})
    headed = {}
    if header and paths:
        # One job for all tables, and one line of each comes back.
        heads = header_names(union_all([parse_lines(scanned(n, heads_only=True), dialect) for n in paths]))
        by_id = {r["table_id"]: r for r in heads.collect()}
        unreadable = [r["path"] for r in by_id.values() if r["names"] is None]
        if unreadable:
            raise ValueError(f"the first line cannot be parsed: {', '.join(sorted(unreadable))}")
        headed = {n: list(by_id[numbered[n]]["names"]) if numbered[n] in by_id else [] for n in paths}
        names_of = {**headed, **names_of}
    lines = {name: without_first_lines(scanned(name)) if header else scanned(name) for name in paths}
    if sample_percent != -1:
        # Drawn from lines, before any is parsed, and once, so that every level sees the same.
        lines = {name: materialize(round_robin_sample(df, sample_percent)) for name, df in lines.items()}
    parsed = {name: parse_lines(df, dialect, null_string) for name, df in lines.items()}
    expected = {n: len(names) for n, names in headed.items() if policy != "warn"} | dict(widths or {})
    unknown = [n for n in paths if n not in expected]
    if unknown:
        # One job for all tables, and one number for each comes back.
        if policy == "warn":
            found = table_widths(union_all([parsed[n] for n in unknown]))
        else:
            heads = [parse_lines(scanned(n, heads_only=True), dialect, null_string) for n in unknown]
            found = first_line_widths(union_all(heads))
        by_id = {r["table_id"]: r["width"] for r in found.collect()}
        expected.update({n: max(by_id.get(numbered[n], 0), len(headed.get(n, ()))) for n in unknown})
    tables = []
    for number, name in enumerate(paths):
        df = apply_width_policy(parsed[name], {numbered[name]: expected[name]}, policy).select("f")
        if spread:
            df = df.repartition(spread)
        width = expected[name] if max_columns < 0 else min(expected[name], max_columns)
        names = names_of.get(name) or []
        if header or not names:
            names = names + [f"column{i + 1}" for i in range(len(names), width)]
        fields = [F.get("f", F.lit(i)) for i in range(width)]
        nulls = [field.isNull() for field in fields]
        tables.append(Table(name, number, df, list(names[:width]), fields, nulls, [T.StringType()] * width))
    out = TableSet(spark, tables, column_bits, digest_long)
    if tables:
        by_id = {numbered[name]: width for name, width in expected.items()}
        out.width_violations = width_violations(union_all(list(parsed.values())), by_id)
    return out


def file_tables(spark: SparkSession, paths: str | list[str], dialect: Dialect = Dialect(), **options) -> DataFrame:
    """(table_id, path, width, lines): what each file holds, under an id that depends on its path alone."""
    parsed = parse_lines(scan_lines(spark, paths, **options), dialect)
    return parsed.groupBy("table_id", "path").agg(F.max("width").alias("width"), F.count(F.lit(1)).alias("lines"))
