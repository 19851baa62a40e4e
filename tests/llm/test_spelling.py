"""Spelling variants against all pairs of words compared one by one."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_samples import DOCUMENTS, odd_rows

from subsumo.llm import spelling


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_apart(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(near), best if best is not None and counts[best] >= 2 * n else None)
    roots = {}
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        roots[w] = root
    return {(w, f, roots[w], n, k, counts[f] if f else None) for w, (n, k, f) in out.items()}


def invented(seed, letters, sizes, number):
    draw = random.Random(seed)
    return {"".join(draw.choice(letters) for _ in range(draw.choice(sizes))): draw.randrange(3, 60) for _ in range(number)}


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("letters,sizes", [("ab", (5, 6, 7)), ("abcé", (5, 6)), ("aÿ", (5, 8, 70, 71))])
def test_index_finds_all_pairs(letters, sizes):
    words = sorted(invented(1, letters, sizes, 300), key=lambda w: (len(w), w))
    index = spelling.PositionIndex(words)
    queries = [*words, "zzzzz", "a" * 200]
    found = {(int(q), int(w)) for part in spelling.near_words(index, queries) for q, w in zip(*part)}
    assert found == {(q, w) for q, a in enumerate(queries) for w, b in enumerate(words) if one_apart(a, b)}


@pytest.mark.parametrize("size", [1 << 15, 7])
def test_groups_in_parts_lose_no_pair(spark, size):
    counts = invented(2, "abcd", (5, 6, 7), 400) | {"aaaaaaa" + "b" * i: 3 << i for i in range(6)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.with_roots(spelling.with_forms(words, group_words=size))) == plain(counts)


def test_documents(spark, odd):
    base = ["receive", "recieve", "receiver", "ÀÉÎÕÜÿ", "colour", "color", "Colours", "éèéèé", "naïveté"]
    draw = random.Random(5)
    texts = [" ".join(draw.choice(base) for _ in range(300)) + "-aaaaa1aaaab_×÷×÷×" * (i % 3) for i in range(25)]
    texts += [None, "", "x" * 9000, "x" * 9000, "x" * 8999 + " y", "x" * 9000, texts[0]]
    data = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    documents = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, word string").repartition(5)
    assert rows(spelling.spelling_variants(documents)) == plain(plain_words(data))
    assert rows(spelling.spelling_variants(odd)) == plain(plain_words([r[:2] for r in odd_rows()]))


def test_empty_table(spark):
    assert rows(spelling.spelling_variants(spark.createDataFrame([], DOCUMENTS))) == set()
