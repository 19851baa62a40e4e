"""Ranked lexical search: the highest-scoring documents of each item, by groups of matched terms.

One scan of the documents keeps, of each, its length and how often it holds each term that any
item asks for. N and L are summed over that table, df and the largest part of a score that a
term has in any document follow from it. It is then read in blocks of documents: a block has one
bitmap for each term, an item's documents are grouped by the mask of its terms that they hold,
and each distinct mask has a maximum score (the sum of the largest parts of its terms). Masks are
evaluated by descending maximum; when it falls below the score of the last rank, no further
mask can hold a better document and the item is finished in this block. The scores of a first few
documents are a bound that all blocks share from the start. What blocks find meets by item.

Items are a stated query set: they are taken in rounds of at most `round_terms` terms, which
bounds what tasks are given. Texts of one item id (also of the null id) are one item. Null and
empty texts have no terms: such a document is never found, such an item finds none. Rows that
repeat are documents of their own and take ranks of their own. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from subsumo.llm.common import Query, pieces, table, text_bytes
from subsumo.session import materialize

RANKS = 50
#: Distinct terms of one round of items; a round may pass this by one item's terms.
ROUND_TERMS = 1 << 18
#: Documents of a block, whose bitmaps a task holds, and masks that are evaluated at once.
BLOCK_DOCUMENTS, MASKS = 1 << 15, 256
#: Parts of the documents whose scores bound all others from the start: one in so many.
FIRST_ONE_IN = 64

#: Letters and digits stand for themselves, A-Z for a-z, bytes of other letters too; what is left separates.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


# --- documents ------------------------------------------------------------------------------


def _terms(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    kind = rows.schema[id_column].dataType.simpleString()
    schema = StructType.fromDDL(f"item_id {kind}, term binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], arrow.field(k).type) for k in (0, 1)], schema=arrow)

    return rows.select(F.col(id_column), text_bytes(text_column)).mapInArrow(run, schema).distinct()


def matched(documents: DataFrame, numbers: dict[bytes, int], *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): a row for each document with terms; of the numbered terms those that it holds, ascending."""
    kind = documents.schema[id_column].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>")
    arrow = to_arrow_schema(schema)
    shared = documents.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches):
            ids, lengths, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                held = sorted((known[t], tf) for t, tf in Counter(words).items() if t in known)
                ids.append(doc_id)
                lengths.append(len(words))
                terms.append(np.array([t for t, _ in held], np.int32))
                tfs.append(np.array([tf for _, tf in held], np.int32))
            columns = zip((ids, lengths, terms, tfs), arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=arrow)

    return documents.select(F.col(id_column), text_bytes(text_column)).mapInArrow(run, schema)


def weight_of(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def parts_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_factor(n: np.ndarray, n_documents: int, all_terms: int) -> np.ndarray:
    return 50 + (50 * n * n_documents) // all_terms


# --- blocks ---------------------------------------------------------------------------------


class Block:
    """Some documents with a bitmap for each term that any of them holds."""

    def __init__(self, ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_documents: int, all_terms: int):
        self.ids, self.width = ids, -(-len(ids) // 8)
        owner = np.repeat(np.arange(len(ids)), sizes)
        by_term = np.argsort(terms, kind="stable")
        terms, self.owner = terms[by_term], owner[by_term]
        parts = parts_of(tfs.astype(np.int64), length_factor(n, n_documents, all_terms)[owner])[by_term]
        self.terms, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))
        self.parts = parts

    def bitmap(self, at: int) -> np.ndarray:
        held = np.zeros(self.width * 8, np.uint8)
        held[self.owner[self.starts[at] : self.ends[at]]] = 1
        return np.packbits(held)

    def best(self, terms: np.ndarray, weights: np.ndarray, largest: np.ndarray, bound: int, ranks: int) -> list[tuple[int, object]]:
        """(score, id) of the documents of an item that may be among its first, all of `bound` at least."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weights, most = at[here], weights[here], (weights * largest)[here]
        if not len(at):
            return []
        # One row of bits for each term, turned into one mask for each document that holds any.
        rows = np.stack([self.bitmap(i) for i in at])
        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(rows, axis=0)))
        masks = np.packbits(np.unpackbits(rows, axis=1)[:, some], axis=0).T
        masks, group = _distinct(masks)
        maximum = np.unpackbits(masks, axis=1)[:, : len(at)].astype(np.int64) @ most
        order = np.argsort(-maximum, kind="stable")
        by_group = np.argsort(group, kind="stable")
        group_ends = np.cumsum(np.bincount(group, minlength=len(masks)))
        group_starts = np.append(0, group_ends[:-1])
        # Scores of evaluated documents only; a document's parts are summed term by term.
        found: list[tuple[int, object]] = []
        bits = np.unpackbits(masks, axis=1)[:, : len(at)]
        place = np.full(self.width * 8, -1)
        for start in range(0, len(order), MASKS):
            chosen = order[start : start + MASKS]
            if maximum[chosen[0]] < bound:
                break
            chosen = chosen[maximum[chosen] >= bound]
            members = some[np.concatenate([by_group[group_starts[g] : group_ends[g]] for g in chosen])]
            place[members] = np.arange(len(members))
            scores = np.zeros(len(members), np.int64)
            for k in np.flatnonzero(bits[chosen].any(axis=0)):
                own = slice(self.starts[at[k]], self.ends[at[k]])
                where = place[self.owner[own]]
                hit = where >= 0
                scores[where[hit]] += weights[k] * self.parts[own][hit]
            place[members] = -1
            good = np.flatnonzero((scores >= bound) & (scores > 0))
            found.extend((int(scores[i]), self.ids[members[i]]) for i in good)
            if len(found) >= ranks:
                found = _first(found, ranks)
                bound = max(bound, found[-1][0])
        return _first(found, ranks)


def _first(found: list[tuple[int, object]], ranks: int) -> list[tuple[int, object]]:
    """Highest scores first, then smallest ids, null ids last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:ranks]


def _distinct(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes, and the number of each row's."""
    wide = np.zeros((len(masks), -(-masks.shape[1] // 8) * 8), np.uint8)
    wide[:, : masks.shape[1]] = masks
    words = wide.view("<u8")
    if words.shape[1] == 1:
        _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        by_word = np.lexsort(words.T)
        new = np.append(True, (words[by_word][1:] != words[by_word][:-1]).any(axis=1))
        group = np.empty(len(masks), np.int64)
        group[by_word] = np.cumsum(new) - 1
        first = by_word[new]
    return masks[first], group


def _blocks(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for piece in pieces([batch], documents):
            held.append(piece)
            if sum(p.num_rows for p in held) >= documents:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


# --- search ---------------------------------------------------------------------------------


def _round(items: list[tuple[object, list[bytes]]], documents: DataFrame, item_kind: str, options: dict) -> DataFrame:
    """(item_id, doc_id, score) of all documents that may be among the first of some items."""
    spark, ranks = documents.sparkSession, options["ranks"]
    numbers = {t: k for k, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    held = materialize(matched(documents, numbers, id_column=options["id_column"], text_column=options["text_column"]))
    n_documents, all_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = StructType.fromDDL(f"item_id {item_kind}, doc_id {held.schema['doc_id'].dataType.simpleString()}, score bigint")
    if not n_documents or not numbers:
        return spark.createDataFrame([], schema)
    m = F.expr(f"50 + (50 * n * {n_documents}L) div {all_terms}L")
    part = F.expr("(1000000000L * x.tfs) div (1000L * x.tfs + 20 * m)")
    spread = held.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    # One row for each term of the round.
    stats = spread.groupBy(F.col("x.terms").alias("t")).agg(F.count(F.lit(1)).alias("df"), F.max(part).alias("most")).collect()
    weight, largest = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    for row in stats:
        weight[row["t"]], largest[row["t"]] = weight_of(n_documents, row["df"]), row["most"]
    asked = [(item, np.sort(np.array([numbers[t] for t in terms], np.int64))) for item, terms in items]
    arrow = to_arrow_schema(schema)

    def searched(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((asked, weight, largest, bounds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, weight, largest, bounds = shared.value
            for read in _blocks(batches, options["block_documents"]):
                lists = read.column("terms").combine_chunks()
                block = Block(
                    read.column("doc_id").to_pylist(), read.column("n").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False),
                    lists.flatten().to_numpy(), read.column("tfs").combine_chunks().flatten().to_numpy(), n_documents, all_terms,
                )
                found = [
                    (item, doc_id, score)
                    for (item, terms), bound in zip(asked, bounds.tolist())
                    for score, doc_id in block.best(terms, weight[terms], largest[terms], bound, ranks)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], arrow.field(k).type) for k in range(3)], schema=arrow)

        return rows.mapInArrow(run, schema)

    bounds = np.ones(len(asked), np.int64)
    place = {item: i for i, (item, _) in enumerate(asked)}
    # A score that so many documents reach is reached by the last rank of all documents too.
    first = searched(held.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(options["first_one_in"])) == 0), bounds)
    for row in _ranked(first, ranks).where(F.col("rank") == ranks).select("item_id", "score").collect():
        bounds[place[row["item_id"]]] = row["score"]
    return searched(held, bounds)


def _ranked(found: DataFrame, ranks: int) -> DataFrame:
    """The first documents of each item with their ranks. Tasks cut their own rows to the first before they meet."""
    in_order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= ranks).select("item_id", "rank", "doc_id", "score")


def ranked_documents(
    documents: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", ranks: int = RANKS, round_terms: int = ROUND_TERMS, block_documents: int = BLOCK_DOCUMENTS,
    first_one_in: int = FIRST_ONE_IN,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the first documents of each item."""
    options = {"id_column": id_column, "text_column": text_column, "ranks": ranks, "block_documents": block_documents, "first_one_in": first_one_in}
    asked = materialize(_terms(items, item_column, item_text_column))
    kind = asked.schema["item_id"].dataType.simpleString()
    rounds = max(1, math.ceil(asked.count() / round_terms))
    found = None
    for number in range(rounds):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == number)
        listed = own.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        part = _round([(r["item_id"], [bytes(t) for t in r["terms"]]) for r in listed], documents, kind, options)
        found = part if found is None else found.unionByName(part)
    return _ranked(found, ranks)


def _query(spark, sf):
    ranked = ranked_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return ranked.select("item_id", "rank", "doc_id", "score")


def _sql() -> str:
    run = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH found AS (SELECT doc_id, regexp_extract_all({lower}, '{run}') AS w FROM documents),
lengths AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM found WHERE len(w) > 0),
total AS (SELECT count(*) AS all_n, CAST(sum(n) AS BIGINT) AS all_l FROM lengths),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower}, '{run}')) AS term FROM benchmark),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM found) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * all_n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, total GROUP BY term, all_n),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_n) // all_l)))) AS BIGINT) AS score
  FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= {RANKS}"""


QUERIES = {"op13_ranked_search": Query(_query, _sql)}
