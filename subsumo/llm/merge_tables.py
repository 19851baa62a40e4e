"""Byte-level BPE with a table of merges, as recursive queries over token positions.

Each Spark task has a DuckDB connection of its own, in memory, with the merges of a vocabulary
as a table: every pair of tokens that spell a third together. A text is cut by the vocabulary's
pattern; pieces that are tokens are done, the others become one row for each byte (word, address,
token). A recursive query joins rows that stand side by side with the merges and contracts each
word's leftmost pair of minimum rank, until no word has a pair left. A word's rows carry the
length of what they spell, so the row behind is found at address plus length. A task keeps the
tokens of words, so that each is contracted once. Ids join the vocabulary and are decoded by
ordered aggregation.

What is in a query at once is bounded: words by the rows that their recursion can make, pieces
by their number, spelled words by a limit after which they are forgotten. In words of over
`LONG_WORD` bytes all places of the minimum pair are contracted at once and rows are kept by
key, not by step. That is the same as one by one if each token is reached by merges of its
own rank at most; for a vocabulary where some token is not, such words go one by one too.

Null and empty texts have no tokens. Special tokens are unknown: their names are ordinary
text. Rows that repeat are encoded each. Bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsumo.llm.common import Query, scan, table, text_bytes

VOCABULARY = "byte_bpe_multi_50k"
#: Longest word, in bytes, whose steps are kept; rows of all steps of the words of one query.
LONG_WORD, STEP_ROWS = 64, 1 << 22
#: Pieces and tokens of one query; spelled words that a task keeps.
QUERY_ROWS, HELD_WORDS = 1 << 20, 1 << 20
#: Texts of more characters are not cut all at once.
LONG_TEXT = 1 << 20

_PAIRS = """
  pairs AS (
    SELECT a.word, a.address, a.length + b.length AS length, b.address AS gone, m.merged
    FROM {rows} a JOIN {rows} b ON b.address = a.address + a.length
    JOIN merges m ON m.pair = a.token::BIGINT * 1048576 + b.token)"""

#: Each word's leftmost pair of minimum rank. Every step has the rows of the words that change in it.
_SHORT = f"""
WITH RECURSIVE state(step, word, address, length, token) AS (
  SELECT 0, word, address, 1, token FROM bytes
  UNION ALL
  (WITH {_PAIRS.format(rows="state")},
  chosen AS (
    SELECT word, least.address, least.length, least.gone, least.merged
    FROM (SELECT word, min(struct_pack(merged := merged, address := address, length := length, gone := gone)) AS least FROM pairs GROUP BY word))
  SELECT s.step + 1, s.word, s.address, CASE WHEN s.address = c.address THEN c.length ELSE s.length END,
    CASE WHEN s.address = c.address THEN c.merged ELSE s.token END
  FROM state s JOIN chosen c ON c.word = s.word WHERE s.address <> c.gone)),
ends AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT s.word, s.address, s.token FROM state s JOIN ends ON s.word = ends.word AND s.step = ends.step"""

#: Places of the minimum pair that do not overlap; of a run of overlapping ones every other, from the left.
_AT_ONCE = """
  least AS (SELECT word, min(merged) AS merged FROM pairs GROUP BY word),
  places AS (
    SELECT p.*, coalesce(lag(gone) OVER (ORDER BY address) <> address, true) AS starts
    FROM pairs p JOIN least ON p.word = least.word AND p.merged = least.merged),
  runs AS (SELECT *, sum(starts::INT) OVER (ORDER BY address) AS run FROM places),
  chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY address) AS k FROM runs) WHERE k % 2 = 1)"""

_ONE_BY_ONE = """
  chosen AS (
    SELECT word, least.address, least.length, least.gone, least.merged
    FROM (SELECT word, min(struct_pack(merged := merged, address := address, length := length, gone := gone)) AS least FROM pairs GROUP BY word))"""


def _long(at_once: bool) -> str:
    """Rows by address; a token that is merged into the one before it has length 0."""
    return f"""
WITH RECURSIVE state(word, address, length, token) USING KEY (address) AS (
  SELECT word, address, 1, token FROM bytes
  UNION
  (WITH alive AS (SELECT * FROM recurring.state WHERE length > 0 AND word IN (SELECT word FROM state)),
  {_PAIRS.format(rows="alive")},
  {_AT_ONCE if at_once else _ONE_BY_ONE}
  SELECT word, address, length, merged FROM chosen UNION ALL SELECT word, gone, 0, -1 FROM chosen))
SELECT word, address, token FROM state WHERE length > 0"""


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, merged) of all tokens that two others spell."""
    return [
        (ranks[t[:i]], ranks[t[i:]], merged) for t, merged in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
    ]


def reached_by_own_rank(ranks: dict[bytes, int]) -> bool:
    """Whether merges of its rank at most lead from the bytes of each token to it."""
    spelled = {rank: token for token, rank in ranks.items()}
    # A token can only fail where a longer part of it has a higher rank.
    asked = {m for a, b, m in merge_table(ranks) if m <= max(x for x in (a, b, -1) if x < 0 or len(spelled[x]) > 1)}
    for rank in asked:
        parts = [spelled[rank][i : i + 1] for i in range(len(spelled[rank]))]
        while len(parts) > 1:
            best = min((ranks.get(parts[i] + parts[i + 1], rank + 1), i) for i in range(len(parts) - 1))
            if best[0] > rank:
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return True


# --- pieces ---------------------------------------------------------------------------------


class Cutter:
    """Matches of the pattern, with the letters and numbers that tiktoken's version of Unicode knows."""

    #: Stand-ins for a letter, a number and any other character; the pattern names none of them.
    _STANDS = ("ж", "٣", "¤")

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        self.pattern = regex.compile(pattern)
        # Classes of these blocks are the same in every Unicode version.
        self.settled = regex.compile("[\x00-Ѐ]*")

    @functools.cached_property
    def other_classes(self) -> dict[int, str]:
        """Characters that the two libraries put into different classes, with a stand-in of the right one."""
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        one_byte_each = {bytes([b]): b for b in range(256)}
        known, own = [], []
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            found = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=one_byte_each, special_tokens={}).encode_ordinary(every)
            known.append(set(bytes(found).decode()))
            own.append(set(regex.findall(kind, every)))
        letter, number, other = self._STANDS
        differ = (known[0] ^ own[0]) | (known[1] ^ own[1]) | (known[2] ^ own[2])
        return {ord(c): letter if c in known[0] else number if c in known[1] else " " if c in known[2] else other for c in differ}

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The pieces in order, some at a time."""
        stands = text
        if not self.settled.fullmatch(text):
            stands = text.translate(self.other_classes)
        if stands is text and len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(stands)
        while block := [text[m.start() : m.end()] for m in islice(matches, QUERY_ROWS // 4)]:
            yield block


# --- codec ----------------------------------------------------------------------------------


class Codec:
    def __init__(self, ranks: dict[bytes, int], *, long_word: int = LONG_WORD, step_rows: int = STEP_ROWS, query_rows: int = QUERY_ROWS, held_words: int = HELD_WORDS):
        self.ranks, self.cutter = ranks, Cutter()
        self.long_word, self.step_rows, self.query_rows, self.held_words = long_word, step_rows, query_rows, held_words
        self.byte_tokens = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1})
        left, right, merged = (np.array(x, np.int64) for x in zip(*merge_table(ranks))) if len(ranks) > 256 else (np.zeros(0, np.int64),) * 3
        self._create("merges", pair=left * 1048576 + right, merged=merged.astype(np.int32))
        self._create("vocabulary", token=np.fromiter(ranks.values(), np.int32), hexed=[t.hex() for t in ranks])
        self._forget()

    @functools.cached_property
    def at_once(self) -> bool:
        return reached_by_own_rank(self.ranks)

    def _create(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        #: Tokens of all words one after another, and by word the first one's place and their number.
        self.spelled = np.zeros(0, np.int32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _contract(self, words: list[tuple[int, bytes]], query: str) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of words, a word's tokens in order."""
        lengths = np.fromiter((len(w) for _, w in words), np.int64, len(words))
        numbers = np.repeat(np.fromiter((n for n, _ in words), np.int32, len(words)), lengths)
        gaps = np.repeat(np.arange(len(words)), lengths)  # words do not touch
        tokens = self.byte_tokens[np.frombuffer(b"".join(w for _, w in words), np.uint8)]
        self.con.register("bytes", pa.table({"word": numbers, "address": (np.arange(len(tokens)) + gaps).astype(np.int32), "token": tokens}))
        found = self.con.execute(f"SELECT word, token FROM ({query}) ORDER BY address").fetchnumpy()
        self.con.unregister("bytes")
        return found["word"], found["token"]

    def _learn(self, new: list[tuple[int, str]]) -> None:
        known, short, long = [], [], []
        for number, piece in new:
            word = piece.encode()
            token = self.ranks.get(word)
            if token is not None:
                known.append((number, token))
            else:
                (long if len(word) > self.long_word else short).append((number, word))
        numbers, tokens = (np.array(x, np.int32) for x in zip(*known)) if known else (np.zeros(0, np.int32),) * 2
        found = [(numbers, tokens)]
        for words, cost, query in ((short, lambda n: n * n // 2, _SHORT), (long, lambda n: 4 * n, None)):
            part, rows = [], 0
            for word in words:
                part.append(word)
                rows += cost(len(word[1]))
                if rows >= self.step_rows:
                    found.append(self._contract(part, query or _long(self.at_once)))
                    part, rows = [], 0
            if part:
                found.append(self._contract(part, query or _long(self.at_once)))
        self._keep(np.concatenate([w for w, _ in found]), np.concatenate([t for _, t in found]))

    def _keep(self, words: np.ndarray, tokens: np.ndarray) -> None:
        """Words are new; a word's tokens stand together."""
        starts = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
        more = len(self.words) - len(self.size)
        self.first, self.size = np.append(self.first, np.zeros(more, np.int64)), np.append(self.size, np.zeros(more, np.int64))
        self.first[words[starts]] = starts + len(self.spelled)
        self.size[words[starts]] = np.diff(np.append(starts, len(words)))
        self.spelled = np.append(self.spelled, tokens)

    def _gather(self, owners: list[int], sizes: list[int], numbers: list[int], out: list[list[np.ndarray]]) -> None:
        """Appends to each text the ids of its next pieces."""
        pieces_ = np.array(numbers, np.int64)
        size = self.size[pieces_]
        ends = np.cumsum(size)
        ids = self.spelled[np.repeat(self.first[pieces_] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        part_ends = np.append(0, ends)[np.cumsum(sizes, dtype=np.int64)]
        for owner, part in zip(owners, np.split(ids, part_ends[:-1])):
            out[owner].append(part)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        owners: list[int] = []
        sizes: list[int] = []
        numbers: list[int] = []
        new: list[tuple[int, str]] = []

        def flush() -> None:
            self._learn(new)
            self._gather(owners, sizes, numbers, out)
            for held in (owners, sizes, numbers, new):
                held.clear()
            if len(self.words) > self.held_words:
                self._forget()

        for owner, text in enumerate(texts):
            for block in self.cutter.blocks(text):
                words = self.words
                for piece in set(block).difference(words):
                    words[piece] = len(words)
                    new.append((words[piece], piece))
                owners.append(owner)
                sizes.append(len(block))
                numbers.extend(map(words.__getitem__, block))
                if len(numbers) >= self.query_rows // 4 or len(new) > self.held_words:
                    flush()
        flush()
        return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]

    def decode(self, sequences: Sequence[Sequence[int]]) -> list[bytes]:
        """The bytes of each sequence of ids; an id that the vocabulary lacks is an error."""
        out: list[list[str]] = [[] for _ in sequences]
        parts: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            sizes = [len(ids) for _, ids in parts]
            tokens = np.concatenate([ids for _, ids in parts]) if parts else np.zeros(0, np.int32)
            rows = {"part": np.repeat(np.arange(len(parts), dtype=np.int32), sizes), "nth": np.arange(len(tokens), dtype=np.int32), "token": tokens}
            self.con.register("ids", pa.table(rows))
            found = self.con.execute(
                "SELECT part, string_agg(hexed, '' ORDER BY nth) AS spelled, count(*) AS n FROM ids JOIN vocabulary USING (token) GROUP BY part ORDER BY part"
            ).fetchall()
            self.con.unregister("ids")
            if sum(n for *_, n in found) != len(tokens):
                raise ValueError("an id is not in the vocabulary")
            for part, spelled, _ in found:
                out[parts[part][0]].append(spelled)
            parts.clear()

        held = 0
        for owner, ids in enumerate(sequences):
            ids = np.asarray(ids, np.int32)
            for start in range(0, len(ids), self.query_rows // 4):
                part = ids[start : start + self.query_rows // 4]
                parts.append((owner, part))
                held += len(part)
                if held >= self.query_rows // 4:
                    flush()
                    held = 0
        flush()
        return [bytes.fromhex("".join(x)) for x in out]


def vocabulary_ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.cache
def codec(vocabulary: str = VOCABULARY) -> Codec:
    """One for each Python worker."""
    return Codec(vocabulary_ranks(vocabulary))


#: What encode_documents can return for a text.
OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode_documents(
    documents: DataFrame, outputs: Iterable[str] = ("ids", "n_tokens"), *, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """A row for each document: its id and the chosen outputs, in the task that reads it."""
    outputs = list(outputs)

    def each(rows: dict[str, list]) -> dict[str, list]:
        own = codec(vocabulary)
        ids = own.encode([text.decode("utf-8", "replace") for text in rows["text"]])
        out = {"doc_id": rows["doc_id"], "ids": ids, "n_tokens": [len(x) for x in ids]}
        if "ids_sha256" in outputs:
            out["ids_sha256"] = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]
        if any(name.startswith("decoded") for name in outputs):
            texts = out["decoded"] = own.decode(ids)
            out["decoded_sha256"] = [hashlib.sha256(text).hexdigest() for text in texts]
        return out

    id_type = documents.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{name} {OUTPUTS[name]}" for name in outputs)])
    return scan(documents, [F.col(id_column).alias("doc_id"), text_bytes(text_column).alias("text")], schema, each)


def decode_documents(encoded: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and bytes of the rows of encode_documents (doc_id, ids); null ids spell nothing."""

    def each(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "decoded": codec(vocabulary).decode([x or [] for x in rows["ids"]])}

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return scan(encoded, [F.col("doc_id"), F.col("ids")], f"doc_id {id_type}, decoded binary", each)


def _query(spark, sf):
    return encode_documents(table(spark, sf, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op12_duckdb_bpe": Query(_query)}
