"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from llm_samples import DOCUMENTS, odd_rows

from subsumo.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(documents, items, ranks=50):
    """Per item the (score, id) of its first documents, highest first."""
    held = [(d, Counter(terms(t))) for d, t in documents if terms(t)]
    df = Counter(t for _, c in held for t in c)
    n_all, l_all = len(held), sum(sum(c.values()) for _, c in held)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = {}
    for item, asked in wanted.items():
        scored = []
        for doc, c in held:
            m = 50 + (50 * sum(c.values()) * n_all) // l_all
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in asked & c.keys()
            )
            if score > 0:
                scored.append((score, doc))
        if scored:
            out[item] = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:ranks]
    return out


def found(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r["rank"] == len(out[r.item_id])
    return out


def corpus(seed, n, vocabulary=60):
    draw = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"É{i}x" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(draw.choices(words, weights, k=draw.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_documents": 7, "first_one_in": 3}, {"round_terms": 40}, {"ranks": 3, "first_one_in": 1}])
def test_first_documents(spark, options):
    documents = corpus(1, 300)
    documents += [(1000 + i, documents[5][1]) for i in range(80)] + [(None, documents[6][1]), (7, documents[7][1])]
    items = [(i, t) for i, t in corpus(2, 12)] + [(50, "W1, w2; w3!" + " W4" * 5), (51, None), (52, "nothing here"), (None, "w7"), (None, "w8 w9")]
    items.append((60, " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"É{i}x" for i in range(0, 60, 5))))
    left = spark.createDataFrame([(i, t, "n") for i, t in documents], "doc_id long, text string, n string").repartition(4)
    right = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    assert found(ranking.ranked_documents(left, right, **options)) == plain(documents, items, options.get("ranks", 50))


def test_odd_texts(spark, odd):
    items = [(1, "quick brown fox word1 word2"), (2, "ünï x"), (3, "")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(ranking.ranked_documents(odd, asked)) == plain([r[:2] for r in odd_rows()], items)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.ranked_documents(empty, items).count() == 0
    some = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCUMENTS)
    assert ranking.ranked_documents(some, items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "--")], "item_id long, text string")
    assert ranking.ranked_documents(some, blank).count() == 0
