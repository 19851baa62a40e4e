"""BPE encoding and decoding with a given vocabulary; long unsplit runs by tree concatenation.

Ordinary text is cut by the vocabulary's pattern into short pieces, which the tokenizer
libraries encode one by one. A run that the pattern leaves whole (one word of thousands of
letters, a long row of blanks) is encoded as a tree: both halves for themselves, then the
tokens around the join again, in a window that grows until its first and last token are
those that the halves have there. A token sequence is the encoding of its text exactly if
every two neighbours are the encoding of what they spell together, so nothing outside such
a window can differ.

Nulls are empty texts; an empty text has no tokens. Rows that repeat are encoded each. The
names of special tokens inside a text become those tokens, as the tokenizer does by default.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from subsumo.llm.common import Query, scan, table, text_bytes

#: Runs of so many bytes without a cut are encoded as a tree; its leaves have half of that at most.
LONG_RUN = 4096

VOCABULARY = "byte_bpe_50k"


def tree_encode(text: str, encode: Callable[[str], list[tuple[int, str]]], leaf: int = LONG_RUN // 2, threads: int = 2) -> list[tuple[int, str]]:
    """Tokens as (id, spelling) of a run that is one piece. encode: the plain encoder of such a run."""
    cuts = [*range(0, len(text), leaf), len(text)]
    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(encode, (text[a:b] for a, b in zip(cuts, cuts[1:]))))
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [joined(*pair, encode) if len(pair) == 2 else pair[0] for pair in pairs]
    return parts[0] if parts else []


def joined(left: list, right: list, encode: Callable[[str], list]) -> list:
    """The encoding of what two encodings spell together."""
    width = 4
    while True:
        a, b = left[-width:], right[:width]
        window = encode("".join(spelling for _, spelling in [*a, *b]))
        left_done = len(a) == len(left) or window[0] == a[0]
        right_done = len(b) == len(right) or window[-1] == b[-1]
        if left_done and right_done:
            return [*left[: len(left) - len(a)], *window, *right[len(b) :]]
        width *= 2


@functools.cache
def encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """Pieces of ordinary text; one for each Python worker, whatever reads the vocabulary there."""
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Codec:
    """Encodes as the tokenizers library does with one vocabulary, and decodes."""

    def __init__(self, vocabulary: str = VOCABULARY, long_run: int = LONG_RUN):
        path = public_tokenizers.path(f"{vocabulary}.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fast = encoding(vocabulary)
        with open(path) as file:
            self.special = [token["content"] for token in json.load(file)["added_tokens"]]
        self.special_ids = {name: self.tokenizer.token_to_id(name) for name in self.special}
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.long_run = long_run
        self.unsplit = re.compile(rf"\S{{{long_run},}}|\s{{{long_run},}}")
        # Letters, digits and blanks of these blocks are the same in every Unicode version.
        self.settled = re.compile("[\x00-ɏ‐-‧]*")

    def encode(self, text: str) -> list[int]:
        if self.special and any(name in text for name in self.special):
            return self._around_special(text)
        if self.unsplit.search(text):
            return self._in_trees(text)
        if text.isascii() or self._is_settled(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _is_settled(self, text: str) -> bool:
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return self.settled.fullmatch(text) is not None

    def _around_special(self, text: str) -> list[int]:
        ids: list[int] = []
        end = 0
        for match in self.cut_special.finditer(text):
            ids.extend(self.encode(text[end : match.start()]))
            ids.append(self.special_ids[match.group()])
            end = match.end()
        ids.extend(self.encode(text[end:]))
        return ids

    def _in_trees(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            encode = tree_encode if len(piece) > self.long_run else None
            tokens = encode(piece, self._plain, self.long_run // 2) if encode else self._plain(piece)
            ids.extend(i for i, _ in tokens)
        return ids

    def _plain(self, piece: str) -> list[tuple[int, str]]:
        return [(token.id, token.value) for token in self.tokenizer.model.tokenize(piece)]

    def decode(self, sequences: Iterable) -> list[str]:
        # One after another: the library's batches take a thread, with memory of its own, for each core of the machine.
        return [self.tokenizer.decode(ids, skip_special_tokens=False) for ids in sequences]


@functools.cache
def codec(vocabulary: str = VOCABULARY, long_run: int = LONG_RUN) -> Codec:
    """One for each Python worker."""
    return Codec(vocabulary, long_run)


#: What encode_documents can return for a text.
OUTPUTS = {
    "ids": "array<int>",
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded": "string",
    "decoded_sha256": "string",
}


def encode_documents(
    documents: DataFrame,
    outputs: Iterable[str] = ("ids", "n_tokens"),
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    long_run: int = LONG_RUN,
) -> DataFrame:
    """A row for each document: its id and the chosen outputs, in the task that reads it."""
    outputs = list(outputs)
    decodes = any(name.startswith("decoded") for name in outputs)

    def each(rows: dict[str, list]) -> dict[str, list]:
        own = codec(vocabulary, long_run)
        ids = [own.encode(text.decode("utf-8", "replace")) for text in rows["text"]]
        out = {"doc_id": rows["doc_id"], "n_tokens": [len(x) for x in ids]}
        if "ids" in outputs:
            out["ids"] = [np.asarray(x, np.int32) for x in ids]
        if "ids_sha256" in outputs:
            out["ids_sha256"] = [hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest() for x in ids]
        if decodes:
            texts = out["decoded"] = own.decode(ids)
            out["decoded_sha256"] = [hashlib.sha256(text.encode()).hexdigest() for text in texts]
        return out

    id_type = documents.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{name} {OUTPUTS[name]}" for name in outputs)])
    columns = [F.col(id_column).alias("doc_id"), text_bytes(text_column).alias("text")]
    return scan(documents, columns, schema, each)


def decode_documents(encoded: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts from the rows of encode_documents (doc_id, ids)."""

    def each(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "text": codec(vocabulary).decode([x or [] for x in rows["ids"]])}

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return scan(encoded, [F.col("doc_id"), F.col("ids")], f"doc_id {id_type}, text string", each)


def digests(documents: DataFrame) -> DataFrame:
    return encode_documents(documents, ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op9_bpe_round_trip": Query(lambda spark, sf: digests(table(spark, sf, "documents")))}
