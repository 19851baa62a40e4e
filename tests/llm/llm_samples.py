"""Rows with everything that the operators must bear."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
PROSE = "the quick brown fox jumps over the lazy dog while many other animals look on from the old barn door"


def odd_rows():
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    texts = [None, "", " \n\t ", "one", "two words", PROSE, PROSE, PROSE.upper(), PROSE + " again", "x" * 9000, long, long + " end", "ünï çödé wörd\n" * 30]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, PROSE, "en", "s1", 3), (None, None, None, None, None)]
