"""Quality rules: stated rules first, then robust multivariate outliers by language and source.

Each text becomes a vector of four transformed statistics. For every cell (a language and a
source) the minimum-covariance-determinant estimate of location and scatter is found by
concentration steps: the share `SHARE` of the rows nearest to the last estimate gives the next
one. A step is a distributed aggregation: distances are arithmetic on columns, their
quantile and the moments of the nearest rows are sums by cell, so no cell is ever gathered
in one task. A cell with few rows takes the estimate of its language, or of the whole table,
which rest on all rows of the language or table, those of large cells too.
Rows whose squared Mahalanobis distance is above a chi-square quantile are rejected.

Nulls are texts without words. Texts without words fail the stated rules and take no part
in the estimates. Null languages and sources are cells of their own. Rows that repeat count
each, and get equal verdicts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsumo.llm.common import Query, scan, table, text_bytes, window_hashes, word_hashes
from subsumo.session import materialize

#: Share of the rows of a cell that the estimate rests on; concentration steps; rows of a cell
#: that has an estimate of its own; probability that a row of a normal cell is rejected.
SHARE, STEPS, LEAST_ROWS, REJECTED = 0.75, 3, 200, 1e-10
#: Standard deviations that no statistic goes below: smaller differences mean nothing.
FLOORS = (0.5, 0.1, 0.05, 0.1)
DIMENSIONS = len(FLOORS)

# The stated symbols and rules.
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 5, 10, 20


def text_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    word_bytes = sum(map(len, words))
    # Continuation bytes of UTF-8 begin no character.
    continued = len(text) - len(text.translate(None, _CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(words), word_bytes - continued, symbols, len(lines) - len(set(lines)), repeated_words(words)


_CONTINUED = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words that the text has twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = window_hashes(word_hashes(words), WINDOW)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    repeated = np.zeros(len(windows), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : len(windows) + i] |= repeated
    return int(covered.sum())


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(documents: DataFrame) -> DataFrame:
    def each(rows: dict[str, list]) -> dict[str, list]:
        columns = list(zip(*map(text_statistics, rows["text"]))) or [[]] * len(STATISTICS)
        return {"doc_id": rows["doc_id"], "lang": rows["lang"], "source": rows["source"], **dict(zip(STATISTICS, columns))}

    kept = ("doc_id", "lang", "source")
    schema = [f"{c} {documents.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} bigint" for c in STATISTICS]
    return scan(documents, [*map(F.col, kept), text_bytes().alias("text")], ", ".join(schema), each)


def transformed() -> list[Column]:
    """Length, word length, symbols and repetition, on scales that are near normal."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(words.cast("double")),
        F.log((F.col("word_chars") + 1) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_repeat_words") / words) + F.sqrt(F.col("n_dup_lines") / words),
    ]


def chi_square(x: float, dimensions: int) -> float:
    """The distribution function for an even number of dimensions."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dimensions // 2))


def chi_square_quantile(p: float, dimensions: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dimensions) < p else (low, middle)
    return high


#: The nearest rows spread less than all do; this factor makes up for it.
CONSISTENCY = SHARE / chi_square(chi_square_quantile(SHARE, DIMENSIONS), DIMENSIONS + 2)

_X = [f"x{i}" for i in range(DIMENSIONS)]
_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]


def distance() -> Column:
    """The squared distance of x from the centre under the inverse scatter."""
    gap = [F.col(x) - F.col("centre")[i] for i, x in enumerate(_X)]
    terms = [(1 if i == j else 2) * gap[i] * gap[j] * F.col("inverse")[k] for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def with_cells(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The cell that each row is judged by (its language and source, its language, or everything) and
    the cells whose estimates it feeds: its own one, and those of its language and of everything where others are judged by them."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source"))
    rows = rows.withColumns({"lang_key": lang, "source_key": source})
    counts = rows.groupBy("lang_key", "source_key").agg(F.count(F.lit(1)).alias("n"))
    of_lang = counts.groupBy("lang_key").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least_n"))
    of_all = of_lang.agg(F.min("n_lang").alias("least_lang"))
    large = F.when(F.col("n") >= least_rows, F.to_json(F.struct("lang_key", "source_key")))
    large_lang = F.when(F.col("n_lang") >= least_rows, F.to_json(F.struct("lang_key")))
    feeds = F.array_compact(F.array(large, F.when(F.col("least_n") < least_rows, large_lang), F.when(F.col("least_lang") < least_rows, F.lit("all"))))
    cells = counts.join(of_lang, "lang_key").crossJoin(of_all)
    cells = cells.select("lang_key", "source_key", F.coalesce(large, large_lang, F.lit("all")).alias("cell"), feeds.alias("feeds"))
    return rows.join(cells, ["lang_key", "source_key"]).drop("lang_key", "source_key")


def estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """cell, centre and inverse (scatter, upper triangle) of rows with cells and x columns."""
    inverted = F.pandas_udf(inverses, "array<double>")
    start = rows.groupBy("cell").agg(
        F.array(*(F.percentile_approx(x, 0.5, 1000) for x in _X)).alias("centre"),
        F.array(*(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.75)), 1000) for x in _X)).alias("quartiles"),
    )
    spread = [F.greatest((F.col("quartiles")[i][1] - F.col("quartiles")[i][0]) / 1.349, F.lit(f)) for i, f in enumerate(FLOORS)]
    inverse = F.array(*(1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i, j in _PAIRS))
    found = materialize(start.select("cell", "centre", inverse.alias("inverse")))
    for _ in range(steps):
        placed = rows.join(found, "cell").select("cell", *_X, distance().alias("d"))
        limits = materialize(placed.groupBy("cell").agg(F.percentile_approx("d", share, 1000).alias("most")))
        near = placed.join(limits, "cell").where(F.col("d") <= F.col("most"))
        moments = near.groupBy("cell").agg(
            F.array(*(F.avg(x) for x in _X)).alias("centre"),
            F.array(*(F.covar_pop(_X[i], _X[j]) for i, j in _PAIRS)).alias("scatter"),
        )
        found = materialize(moments.select("cell", "centre", inverted("scatter").alias("inverse")))
    return found


def inverses(scatters: pd.Series) -> pd.Series:
    """Upper triangles of the inverses, one small matrix for each cell."""

    def one(triangle):
        full = np.zeros((DIMENSIONS, DIMENSIONS))
        for value, (i, j) in zip(triangle, _PAIRS):
            full[i, j] = full[j, i] = value * CONSISTENCY
        inverse = np.linalg.inv(full + np.diag(np.square(FLOORS)))
        return [inverse[i, j] for i, j in _PAIRS]

    return scatters.map(one)


def judged(documents: DataFrame, *, rejected: float = REJECTED, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, the statistics, base_failed, distance and kept of every document."""
    rows = materialize(with_statistics(documents))
    rows = rows.withColumns(dict(zip(_X, transformed())))
    rows = materialize(with_cells(rows, least_rows))
    found = estimates(rows.where("n_words > 0").withColumn("cell", F.explode("feeds")))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    most = chi_square_quantile(1 - rejected, DIMENSIONS)
    placed = rows.join(found, "cell", "left").withColumns({"base_failed": base, "distance": distance()})
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= most, F.lit(True))
    return placed.select("doc_id", *STATISTICS, "base_failed", kept.alias("kept"), "distance")


QUERIES = {"op5_quality_outliers": Query(lambda spark, sf: judged(table(spark, sf, "documents")))}
