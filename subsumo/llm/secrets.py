"""Secret scans: stated signatures, and random strings that a tokenizer finds hard to spell.

A vocabulary learned from prose and code spells words with few tokens: four or more
characters each. Keys drawn at random need a token for every two characters or less. The
scan takes runs of letters, digits and the marks of base64 texts, puts aside what is known to
look random without being secret (digests in hexadecimal, UUIDs, names made of words) and
reports runs with few characters a token. Of other runs it looks at the parts between marks:
names and paths joined to a key make a run readable, so they are taken off and what is left
is tested. Such a span never hides one of a stated kind.

Spans are counted in code points, ends exclusive. Nulls are empty texts, which have no spans.
Rows that repeat are scanned each; ties at one start keep the order of the kinds.
"""

from __future__ import annotations

import hashlib
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsumo.llm.bpe import VOCABULARY, encoding
from subsumo.llm.common import Query, scan, table, text_bytes

#: Runs of so many characters with at most so many characters a token are taken for random.
SHORTEST, RATIO = 20, 2.0

KINDS = ("assign", "access", "hex", "random")
# The stated signatures.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")

RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:md5|sha1|sha256|sha384|sha512)?[-_=]?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
#: Words joined by marks or by capitals, with a number at the end of a word at most; also paths.
_WORD = r"(?>[A-Z]?[a-z]{2,}+[0-9]{0,4}+|[A-Z]{2,}+[0-9]{0,4}+|[0-9]{1,8}+)"
IDENTIFIER = re.compile(rf"[-_/+=]*+(?:{_WORD}[-_/+=]*+)++")
PART = re.compile(r"[A-Za-z0-9]+")
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|{DIGEST.pattern})(?![A-Za-z0-9])")
#: Parts of so many characters with at least so many characters a token are read as words.
WORD_LENGTH, WORD_RATIO = 5, 3.0


def signature_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the stated kinds as (start, kind number, end)."""
    low = text.lower() if text.isascii() else None
    spans = []
    # A scan for a short word is much faster than the pattern; other letters may fold, so only ASCII texts skip.
    if low is None or any(word in low for word in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(spans)


def is_random(run: str, ratio: float = RATIO, vocabulary: str = VOCABULARY) -> bool:
    """Known digests and identifiers are not; letters alone must mix cases, as words do not."""
    if UUID.fullmatch(run) or DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    if len({"d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "" for c in run} - {""}) < 2:
        return False
    return len(run) <= ratio * len(encoding(vocabulary).encode_ordinary(run))


def random_parts(run: str, ratio: float = RATIO, vocabulary: str = VOCABULARY) -> list[tuple[int, int]]:
    """Random spans of a run that is readable as a whole, between known digests and UUIDs."""
    found, start = [], 0
    for known in [*KNOWN.finditer(run), None]:
        end = known.start() if known else len(run)
        parts = [(m.start(), m.end(), _readable(m.group(), vocabulary)) for m in PART.finditer(run, start, end)]
        found += _random_parts(run, end, parts, ratio, vocabulary)
        start = known.end() if known else end
    return found


def _readable(part: str, vocabulary: str) -> bool:
    if IDENTIFIER.fullmatch(part):
        return True
    return len(part) >= WORD_LENGTH and len(part) >= WORD_RATIO * len(encoding(vocabulary).encode_ordinary(part))


def _random_parts(run: str, end: int, parts: list[tuple[int, int, bool]], ratio: float, vocabulary: str) -> list[tuple[int, int]]:
    """All from the first to the last part that is no word, else stretches without words, else single parts."""

    def random(stretch: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
        a, b = stretch[0][0], stretch[-1][1]
        if not run[b:end].strip("="):
            b = end
        return [(a, b)] if SHORTEST <= b - a < len(run) and is_random(run[a:b], ratio, vocabulary) else []

    stretches = [list(group) for word, group in itertools.groupby(parts, lambda part: part[2]) if not word]
    if not stretches:
        return []
    whole = parts[parts.index(stretches[0][0]) : parts.index(stretches[-1][-1]) + 1]
    return random(whole) or [span for s in stretches for span in random(s) or [x for part in s for x in random([part])]]


def secret_spans(text: str, ratio: float = RATIO, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """All spans as (start, kind number, end), sorted."""
    spans = signature_spans(text)
    for m in RUN.finditer(text):
        if is_random(m.group(), ratio, vocabulary):
            spans.append((m.start(), 3, m.end()))
        else:
            spans += [(m.start() + a, 3, m.start() + b) for a, b in random_parts(m.group(), ratio, vocabulary)]
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with its spans, overlapping ones as one, replaced by the mark."""
    out, end = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[end:a], mark]
        end = b
    return "".join([*out, text[end:]])


def scan_secrets(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", ratio: float = RATIO, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each document its spans as arrays of (kind, start, end) and as digest columns."""

    def each(rows: dict[str, list]) -> dict[str, list]:
        found = [secret_spans(text.decode("utf-8", "replace"), ratio, vocabulary) for text in rows["text"]]
        base = [[s for s in spans if s[1] < 3] for spans in found]
        return {
            "doc_id": rows["doc_id"],
            "n_assign": [sum(s[1] == 0 for s in spans) for spans in base],
            "n_access": [sum(s[1] == 1 for s in spans) for spans in base],
            "n_hex": [sum(s[1] == 2 for s in spans) for spans in base],
            "base_sha256": [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base],
            "spans": [written(spans) for spans in found],
        }

    id_type = documents.schema[id_column].dataType.simpleString()
    schema = f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return scan(documents, [F.col(id_column).alias("doc_id"), text_bytes(text_column).alias("text")], schema, each)


def redact_secrets(documents: DataFrame, *, text_column: str = "text", count_column: str | None = None, ratio: float = RATIO, vocabulary: str = VOCABULARY) -> DataFrame:
    """All documents and columns, with a mark in place of every span; null texts stay null.

    count_column: the column that holds the number of code points, written anew."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            spans = secret_spans(text, ratio, vocabulary)
            return redacted(text, spans) if spans else text

        return texts.map(one)

    out = documents.withColumn(text_column, clean(F.col(text_column)))
    if count_column and count_column in documents.columns:
        kind = documents.schema[count_column].dataType
        out = out.withColumn(count_column, F.coalesce(F.length(text_column).cast(kind), F.col(count_column)))
    return out


QUERIES = {"op10_secret_scan": Query(lambda spark, sf: scan_secrets(table(spark, sf, "documents")))}
