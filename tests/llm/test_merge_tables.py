"""Recursive contraction against the tiktoken library."""

import hashlib
import random

import pytest
import public_tokenizers
import tiktoken
from llm_samples import odd_rows

from subsumo.llm import merge_tables


@pytest.fixture(scope="module")
def library():
    ranks = merge_tables.vocabulary_ranks()
    return tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    draw = random.Random(1)
    out = [t or "" for _, t, *_ in odd_rows()]
    for letters in ("ab", "etaoin shrdlu'", "aé日本語 \n\t", "0123456789abcdefXYZ+/=", "𐌰😀ж٣¤ ​　"):
        out += ["".join(draw.choice(letters) for _ in range(draw.randrange(400))) for _ in range(20)]
    out += ["a" * 5000, " " * 3000 + "x", "ab" * 700 + "!" * 300, "<|endoftext|> it's I'LL", "\x00\x00a\r\n\r\n b"]
    out += ["".join(map(chr, range(start, start + 3000))) for start in (0x530, 0x1000, 0x9000, 0x11000, 0x1D000, 0x2CE00)]
    return out


@pytest.mark.parametrize("options", [{}, {"long_word": 3}, {"step_rows": 3000, "query_rows": 4000, "held_words": 200}])
def test_ids_are_those_of_the_library(library, options):
    own = merge_tables.Codec(merge_tables.vocabulary_ranks(), **options)
    given = texts()
    for _ in range(2):  # words that are spelled already
        ids = own.encode(given)
        assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in given]
    assert own.decode(ids) == [t.encode() for t in given]


def test_long_texts_are_cut_in_parts(library, monkeypatch):
    monkeypatch.setattr(merge_tables, "LONG_TEXT", 100)
    own = merge_tables.Codec(merge_tables.vocabulary_ranks(), query_rows=256)
    long = " ".join(f"word{i % 997} naïve" for i in range(3000))
    assert [x.tolist() for x in own.encode(["", long, "x"])] == [library.encode_ordinary(t) for t in ("", long, "x")]


def plain(ranks, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(4))
def test_vocabularies_that_no_training_gives(seed):
    """Tokens of random ranks, which merges of their own rank do not reach: long words go one by one."""
    draw = random.Random(seed)
    tokens = {"".join(draw.choice("abc") for _ in range(draw.randrange(2, 5))).encode() for _ in range(40)}
    order = [bytes([b]) for b in range(256)] + sorted(tokens)
    draw.shuffle(order)
    ranks = {t: i for i, t in enumerate(order)}
    own = merge_tables.Codec(ranks, long_word=8)
    words = ["".join(draw.choice("abc") for _ in range(draw.randrange(1, 40))) for _ in range(60)]
    want = [[ranks[w.encode()]] if w.encode() in ranks else plain(ranks, w.encode()) for w in words]
    assert [x.tolist() for x in own.encode(words)] == want
    assert not own.at_once


def test_trained_vocabularies_allow_contraction_at_once():
    for name in ("byte_bpe_multi_50k", "byte_bpe_50k"):
        assert merge_tables.reached_by_own_rank(merge_tables.vocabulary_ranks(name))


def test_unknown_ids():
    with pytest.raises(ValueError):
        merge_tables.codec().decode([[1, 10**6]])


def test_documents(spark, odd, empty, library):
    rows = merge_tables.encode_documents(odd, merge_tables.OUTPUTS).collect()
    want = sorted((str(i), tuple(library.encode_ordinary(t or ""))) for i, t, *_ in odd_rows())
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in rows) == want
    for r in rows:
        assert r.n_tokens == len(r.ids) and bytes(r.decoded) == library.decode_bytes(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()
    back = merge_tables.decode_documents(merge_tables.encode_documents(odd, ("ids",)))
    assert sorted(bytes(r.decoded).decode() for r in back.collect()) == sorted(t or "" for _, t, *_ in odd_rows())
    assert merge_tables.encode_documents(empty).count() == 0
