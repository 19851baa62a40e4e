"""Text lines of many files, tagged with the table they belong to."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a unit of charsets whose newline is not a single byte; both orders of bytes.
_WIDE = {"UTF-16LE": 2, "UTF-16BE": 2, "UTF-32LE": 4, "UTF-32BE": 4}


def scan_lines(
    spark: SparkSession,
    paths: str | list[str],
    table_id: int | Column | None = None,
    encoding: str = "UTF-8",
    strip_bom: bool = True,
    recursive: bool = False,
    name_regex: str | None = None,
    glob: str | None = None,
    max_depth: int | None = None,
    heads_only: bool = False,
    whole_files: bool = False,
) -> DataFrame:
    """(table_id, path, block_start, row_in_block, value), one row per line.

    ``table_id`` is a given number, or :func:`path_id` if left out. Compressed files are
    read by their suffix; they cannot be split, so use one file per wanted task.
    ``name_regex``, ``glob`` and ``max_depth`` choose files as in :func:`list_files`. Lines end
    with a newline; a carriage return in front of it is no part of the line. ``encoding`` may
    be ``<bom>:<charset>``, with any charset of the JVM. ``heads_only`` reads the first block of every file.

    Lines are split as bytes and then decoded; bytes that the charset lacks become U+FFFD. In UTF-16
    and UTF-32 the separator has the charset's width. Two characters side by side may hold its bytes
    across their border (U+0A00 to U+0AFF next to U+xx00): such a file fails, and is read right
    with ``whole_files``, which takes each file in one piece of at most 2 GB. That is also the way
    for UTF-16 and UTF-32 files whose order of bytes only their mark tells."""
    marked, charset = parse_encoding(encoding)
    plain = charset.upper() in ("UTF-8", "UTF8", "UTF_8")
    unit = _WIDE.get(_canonical(charset), 1)
    if _canonical(charset) in ("UTF-16", "UTF-32") and not whole_files:
        raise ValueError(f"{charset} does not say the order of bytes: name {charset}LE or {charset}BE, or read whole files")
    reader = spark.read.option("recursiveFileLookup", str(recursive or max_depth is not None).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if whole_files:
        lines = reader.format("binaryFile").load(paths)
    else:
        separator = {"lineSep": "\n"} if unit == 1 else {"lineSep": "\n", "encoding": _canonical(charset)}
        lines = reader.options(**separator).text(paths)
    path = F.col("_metadata.file_path")
    if name_regex is not None:
        lines = lines.where(F.col("_metadata.file_name").rlike(f"^(?:{name_regex})$"))
    if max_depth is not None:
        lines = lines.where(_depth(path, paths) <= max_depth)
    if heads_only and not whole_files:
        # On the source itself, so that other blocks are not even opened.
        lines = lines.where(F.col("_metadata.file_block_start") == 0)
    tag = path_id(F.col("_metadata.file_path")) if table_id is None else table_id
    bytes_ = F.col("content") if whole_files else F.col("value").cast("binary")
    if unit > 1 and not whole_files:
        message = F.concat(F.lit("a line of another width than the charset's: read whole files, "), F.col("_metadata.file_path"))
        bytes_ = F.when(F.octet_length(bytes_) % unit == 0, bytes_).otherwise(F.raise_error(message).cast("binary"))
    at = [
        (F.lit(tag) if isinstance(tag, int) else tag).alias("table_id"),
        F.col("_metadata.file_path").alias("path"),
        (F.lit(0).cast("bigint") if whole_files else F.col("_metadata.file_block_start")).alias("block_start"),
    ]
    with any_charset(spark):
        value = F.col("value") if plain and not whole_files else F.decode(bytes_, _canonical(charset))
        found = lines.select(*at, value.alias("value"))
    if whole_files:
        # A newline at the end ends the last line and does not begin another; an empty file has no line.
        text = F.regexp_replace("value", "\n$", "")
        found = found.where("value <> ''").withColumn("value", F.explode(F.split(text, "\n", -1)))
    value = F.regexp_replace("value", "\r$", "")
    if strip_bom or marked:
        value = F.when(value.startswith("\ufeff"), F.substring(value, 2, 2**31 - 1)).otherwise(value)
    return found.select("table_id", "path", "block_start", F.monotonically_increasing_id().alias("row_in_block"), value.alias("value"))


def without_first_lines(lines: DataFrame) -> DataFrame:
    """The lines of a scan without the first one of every file.

    A task reads a file's block from its start to its end, so the first row that it meets
    of a path's first block is the file's first line. Only the order of rows tells, which no built-in
    function sees without a shuffle by file: batches pass through Arrow, whole and in their order."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            path, start = batch.column("path"), batch.column("block_start")
            begins = pc.not_equal(path, pa.concat_arrays([path.slice(0, 1), path.slice(0, batch.num_rows - 1)]))
            head = pa.array([path[0].as_py() != last])
            begins = pa.concat_arrays([head, begins.slice(1)])
            last = path[batch.num_rows - 1].as_py()
            yield batch.filter(pc.invert(pc.and_(begins, pc.equal(start, 0))))

    return lines.mapInArrow(rest, lines.schema)


def _canonical(charset: str) -> str:
    """UTF-16LE for utf_16le, UTF16-LE and the like; other names as they are."""
    wide = re.fullmatch(r"UTF[-_]?(16|32)[-_]?(LE|BE)?", charset.upper())
    return f"UTF-{wide[1]}{wide[2] or ''}" if wide else charset


@contextmanager
def any_charset(spark: SparkSession):
    """Columns that are made within it decode any charset of the JVM and replace what is malformed."""
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def path_id(path: Column) -> Column:
    """A file id that depends on the path alone."""
    return F.xxhash64(path)


def parse_encoding(text: str | None) -> tuple[bool, str]:
    """(has a byte order mark, charset) from ``<bom>:<charset>`` or a bare charset."""
    if not text:
        return False, "UTF-8"
    bom, _, charset = text.rpartition(":")
    return bool(bom) and bom.upper() != "NONE", charset or "UTF-8"


def list_files(
    spark: SparkSession, root: str, name_regex: str | None = None, max_depth: int | None = None, glob: str | None = None
) -> DataFrame:
    """(path, length) of the files below a folder; contents are not read.

    ``max_depth`` 1 means the folder itself, 2 its direct subfolders too, and so on."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select("path", "length")
    if name_regex is not None:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{name_regex})$"))
    if max_depth is not None:
        files = files.where(_depth(F.col("path"), root) <= max_depth)
    return files


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _depth(path: Column, roots: str | list[str]) -> Column:
    """Folders between a file and the root it lies below, itself included."""
    own = F.size(F.filter(F.split(F.regexp_replace(path, _SCHEME, ""), "/+"), lambda p: p != ""))
    depth = F.lit(None)
    for root in [roots] if isinstance(roots, str) else roots:
        plain = "/" + "/".join(p for p in re.split("/+", re.sub(_SCHEME, "", root)) if p)
        depth = F.coalesce(depth, F.when(F.regexp_replace(path, _SCHEME, "").startswith(plain), own - len(plain.split("/")) + 1))
    return depth
