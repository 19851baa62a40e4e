"""Spelling variants: which words of the corpus differ from another by one letter, and what they stand for.

Words are counted in one scan, combined in the tasks. Two words that differ by one inserted,
deleted or replaced letter share their first or their last two letters (a word has five at
least), so the vocabulary is dealt to groups by these. A group is searched with a bit-sliced
position index: for each (position, letter) a bit set over the group's words. A query reads its
letters once; at each of them four bit sets move on word by word: no error so far, one
replaced letter (same position), one letter deleted (index one position behind) and one
inserted (one position ahead). Bit sets by length say which words end there.

Groups over `group_words` words or `group_letters` letters are split: every part of a group's
words is looked for in every part's index, each pair of parts in a task of its own, so that no
group is held by one task and no pair of words is left out. Pairs that share both ends are only
taken from the group of the first letters. Roots follow the forms by pointer doubling, as a
form's count is at least twice its word's.

Null and empty texts have no words; a null id counts as an empty one in the key of a deletion;
rows that repeat count again; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from subsumo.llm.common import Query, ascii_lower, pieces, table, text_bytes
from subsumo.session import materialize

LEAST_LETTERS, LEAST_COUNT, FACTOR = 5, 3, 2
#: One in so many (document, word) pairs loses a letter.
DELETE_ONE_IN = 97
#: Most words and letters of one part of a group. What a task holds follows from them alone.
GROUP_WORDS, GROUP_LETTERS = 1 << 15, 1 << 20
#: Counted words that a task holds before it hands them on.
HELD_WORDS = 1 << 18
#: Bit-set words (of 64) that a step of the recurrences works on.
STEP = 1 << 17


@functools.cache
def _runs(least: int) -> re.Pattern:
    """Maximal runs of so many letters: a shorter one has no place where so many stand."""
    return re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)


# --- words ----------------------------------------------------------------------------------


def text_words(doc_id, text: bytes, one_in: int = DELETE_ONE_IN, least_letters: int = LEAST_LETTERS) -> dict[str, int]:
    """Counts of a text's words that are long enough after deletions."""
    runs = Counter(_runs(least_letters).findall(ascii_lower(text).decode("utf-8", "replace")))
    start, crc32 = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode())), zlib.crc32
    chosen = [(run, h) for run in runs if (h := crc32(run.encode(), start)) % one_in == 0]
    whole = {run: runs.pop(run) for run, _ in chosen}
    for run, h in chosen:
        at = h % len(run)
        if len(run) > least_letters:
            runs[run[:at] + run[at + 1 :]] += whole[run]
    return runs


def vocabulary(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, one_in: int = DELETE_ONE_IN, held_words: int = HELD_WORDS,
) -> DataFrame:
    """(word, n): the words that are long and frequent enough."""
    schema = StructType.fromDDL("word string, n bigint")
    arrow = to_arrow_schema(schema)

    def rows(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in text_words(doc_id, text, one_in, least_letters).items():
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > held_words:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    found = documents.select(F.col(id_column), text_bytes(text_column)).mapInArrow(count, schema)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- bit-sliced index -----------------------------------------------------------------------


class PositionIndex:
    """Bit sets over a list of words, ordered by length, by (position, letter)."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = _letters(words)
        owner = np.repeat(np.arange(len(words)), self.lengths)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.keys, row = np.unique(_key(place, letters), return_inverse=True)
        # The last row is the empty set, for letters that no word has at a place.
        self.sets = np.zeros((len(self.keys) + 1, -(-len(words) // 64)), np.uint64)
        np.bitwise_or.at(self.sets, (row, owner // 64), np.uint64(1) << (owner % 64).astype(np.uint64))

    def range(self, least: int, most: int) -> tuple[int, int]:
        """The words of these lengths stand together: first and end."""
        return int(np.searchsorted(self.lengths, least)), int(np.searchsorted(self.lengths, most + 1))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all pairs one error apart. Queries are rows of letters, all of one length."""
        n, m = queries.shape
        first, end = self.range(m - 1, m + 1)
        low, high = first // 64, -(-end // 64)
        sets = self.sets[:, low:high]

        def at(place: int, letters: np.ndarray) -> np.ndarray:
            """For each query's letter the words that have it at this place."""
            return sets[_rows(self.keys, _key(place, letters))]

        ones, none = np.full((n, high - low), ~np.uint64(0)), np.zeros((n, high - low), np.uint64)
        same, replaced, deleted, inserted = ones, none, none, at(1, queries[:, 0])
        for i in range(m):
            letters = queries[:, i]
            here = at(i, letters)
            # A query's letter that the word lacks: what follows stands one position earlier in the word.
            deleted = (deleted & at(i - 1, letters)) | same if i else same
            replaced = (replaced & here) | (same & ~here)
            if i:
                # A letter of the word that the query lacks: what follows stands one position later.
                inserted = (inserted | same) & at(i + 1, letters)
            same = same & here
        found = (replaced & self._of_length(m, low, high)) | (deleted & self._of_length(m - 1, low, high))
        found |= (inserted | same) & self._of_length(m + 1, low, high)
        query, word = np.nonzero(found)
        bits = np.unpackbits(found[query, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        return query[hit], (word[hit] + low) * 64 + bit

    def _of_length(self, length: int, low: int, high: int) -> np.ndarray:
        first, end = self.range(length, length)
        bits = np.zeros((high - low) * 64, np.uint8)
        bits[first - low * 64 : end - low * 64] = 1
        return np.packbits(bits, bitorder="little").view("<u8")


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)


def _key(place, letters):
    return place * np.int64(1 << 21) + letters


def _rows(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    row = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(row, len(keys) - 1)] == wanted, row, len(keys))


def near_words(index: PositionIndex, queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of queries, numbers of index words) of all pairs one error apart, some queries at a time."""
    lengths = np.fromiter(map(len, queries), np.int64, len(queries))
    for length in np.unique(lengths):
        chosen = np.flatnonzero(lengths == length)
        first, end = index.range(length - 1, length + 1)
        if first == end:
            continue
        step = max(1, STEP // ((end - first) // 64 + int(length)))
        for start in range(0, len(chosen), step):
            part = chosen[start : start + step]
            query, word = index.near(_letters([queries[i] for i in part]).reshape(len(part), length))
            yield part[query], word


# --- search ---------------------------------------------------------------------------------

_FOUND = "word string, n bigint, n_near bigint, form_n bigint, form string"


def grouped(words: DataFrame, group_words: int = GROUP_WORDS, group_letters: int = GROUP_LETTERS) -> DataFrame:
    """(side, ends, mine, theirs, asks, listed, word, n): a word for each group and pair of parts that it belongs to.

    Rows with `asks` are queries, rows with `listed` are of the index; a whole group has both in one row."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", 1, 2).alias("ends")),
        F.struct(F.lit(1).alias("side"), F.substring("word", -2, 2).alias("ends")),
    )
    placed = words.select(F.inline(sides), "word", "n")
    sizes = placed.groupBy("side", "ends").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("letters"))
    parts = F.greatest(F.ceil(F.col("words") / group_words), F.ceil(F.col("letters") / group_letters)).cast("int")
    sizes = sizes.where("words > 1").select("side", "ends", parts.alias("parts"))
    met = placed.join(sizes, ["side", "ends"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    roles = F.when(
        F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("mine"), F.lit(0).alias("theirs"), F.lit(True).alias("asks"), F.lit(True).alias("listed")))
    ).otherwise(
        F.concat(
            F.transform(other, lambda p: F.struct(F.col("part").alias("mine"), p.alias("theirs"), F.lit(True).alias("asks"), F.lit(False).alias("listed"))),
            F.transform(other, lambda p: F.struct(p.alias("mine"), F.col("part").alias("theirs"), F.lit(False).alias("asks"), F.lit(True).alias("listed"))),
        )
    )
    return met.select("side", "ends", F.inline(roles), "word", "n")


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """What one part of a group finds among another: counts and best near words of its queries."""
    side = rows["side"].iloc[0]
    asks, listed = rows[rows["asks"]], rows[rows["listed"]]
    queries, words = asks["word"].tolist(), listed["word"].tolist()
    counts = listed["n"].to_numpy(np.int64)
    n_near, best = np.zeros(len(queries), np.int64), [None] * len(queries)
    if words:
        order = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i]))
        words, counts = [words[i] for i in order], counts[order]
        index = PositionIndex(words)
        alphabetic = np.empty(len(words), np.int64)
        alphabetic[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        heads, query_heads = np.array([w[:2] for w in words]), np.array([q[:2] for q in queries])
        for query, word in near_words(index, queries):
            if side:
                both = query_heads[query] != heads[word]
                query, word = query[both], word[both]
            n_near += np.bincount(query, minlength=len(queries))
            by_rank = np.lexsort((alphabetic[word], -counts[word], query))
            query, word = query[by_rank], word[by_rank]
            first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else query
            for q, w in zip(query[first].tolist(), word[first].tolist()):
                best[q] = w
    return pd.DataFrame({
        "word": queries, "n": asks["n"].to_numpy(np.int64), "n_near": n_near,
        "form_n": pd.array([None if b is None else int(counts[b]) for b in best], "Int64"),
        "form": [None if b is None else words[b] for b in best],
    })


def with_forms(words: DataFrame, *, factor: int = FACTOR, group_words: int = GROUP_WORDS, group_letters: int = GROUP_LETTERS) -> DataFrame:
    """(word, n, n_near, form_n, form) of every word of (word, n)."""
    keys = ["side", "ends", "mine", "theirs"]
    # A given number of partitions, as the rows are few bytes for the work that they are.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped(words, group_words, group_letters).repartition(tasks, *keys)
    found = dealt.groupBy(*keys).applyInPandas(_search, _FOUND)
    # A word alone in both of its groups has none near.
    alone = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    merged = found.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    stands = -F.col("best.less") >= factor * F.col("n")
    return merged.select(
        "word", "n", "n_near", F.when(stands, -F.col("best.less")).alias("form_n"), F.when(stands, F.col("best.form")).alias("form")
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root: where a word's forms lead. Each round doubles the way; counts double at each step, so ways are short."""
    steps = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        seen = Observation()
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        steps = materialize(joined.observe(seen, F.count_if("moved").alias("moved")))
        if not seen.get["moved"]:
            break
    return forms.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(documents: DataFrame, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of the documents."""
    words = materialize(vocabulary(documents, **options))
    found = with_roots(materialize(with_forms(words)))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def _query(spark, sf):
    return spelling_variants(table(spark, sf, "documents"))


def _sql() -> str:
    """Near words meet over the words with one letter left out; crc32 by its table of 256 remainders."""
    return rf"""
WITH RECURSIVE remainders AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST([0,0,0,0,0,0,0,0] AS BIGINT[])),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, c, xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(x), 2), lambda i: CAST(CAST('0x' || substr(x, CAST(i AS INTEGER), 2) AS INTEGER) AS BIGINT))),
    lambda s, b: xor(s >> 8, t[CAST(xor(s & 255, b) AS INTEGER) + 1]))) AS h
  FROM bytes, remainders),
deleted AS (
  SELECT CASE WHEN h % {DELETE_ONE_IN} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM deleted WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
holes AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM words a JOIN holes b ON a.word = b.rest
  UNION SELECT b.word, a.word FROM words a JOIN holes b ON a.word = b.rest),
ranked AS (
  SELECT near.word, w.word AS form, w.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, w.word) AS place
  FROM near JOIN words w ON w.word = near.other),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.form_n >= {FACTOR} * w.n THEN r.form END AS form,
    CASE WHEN r.form_n >= {FACTOR} * w.n THEN r.form_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
ways AS (
  SELECT word, word AS here FROM formed UNION ALL SELECT ways.word, formed.form FROM ways JOIN formed ON formed.word = ways.here WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, ways.here AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN ways ON ways.word = f.word JOIN formed last ON last.word = ways.here AND last.form IS NULL"""


QUERIES = {"op11_spelling_variants": Query(_query, _sql)}
