"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share all words by weight. No target is above a given multiple of its source; what
is cut off goes to the other sources by weight until none is above (water filling, solved
by prefix sums over the sources ordered by size over weight). A source is then read in complete
epochs, and the rest of its target is filled by documents in the order of exponential keys
-ln(u) / quality: u comes from a seeded hash of the id, so reruns agree. Keys of a source fall
into slices whose word sums place every slice in the prefix sum. Only the slice in which the
budget ends is looked at row by row, so no source is ever sorted as a whole.

The document at the end of a budget gives only the words that are left (`whole=False`), so
that a source gives its target to the word; with `whole=True` it is taken whole if half of it
fits. Null texts and empty texts have no words and are taken with 0. A null source is a
source of its own, the last one. Rows that repeat count each; rows with equal keys are
ordered by id and size. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subsumo.llm.common import Query, record, scan, table, text_bytes
from subsumo.session import materialize

# Weights of the sources in order, repeating, and the largest multiple.
WEIGHTS, MULTIPLE = (5, 2, 1), 3
#: Slices of a source's keys; seed of the draws.
SLICES, SEED = 1024, 7


def part_of(source: Column) -> Column:
    """A key that also holds null sources."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def key_of(doc_id: Column, quality: Column, seed: int) -> Column:
    """Exponential keys: the smaller, the earlier."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / quality


def quality_of(size: Column, word_chars: Column) -> Column:
    """2 for texts whose words have 3 to 10 characters on average, else 1."""
    return F.when((word_chars >= 3 * size) & (word_chars <= 10 * size) & (size > 0), 2.0).otherwise(1.0)


def measured(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, part, size, key and slice of every document."""

    def each(rows: dict[str, list]) -> dict[str, list]:
        sizes, chars = [], []
        for length, text in zip(rows["length"], rows["text"]):
            words = text.split()
            sizes.append(len(words))
            chars.append(length - len(text) + sum(map(len, words)))
        return {"doc_id": rows["doc_id"], "source": rows["source"], "size": sizes, "word_chars": chars}

    id_type, source_type = (documents.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    columns = [F.col("doc_id"), F.col("source"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), text_bytes().alias("text")]
    rows = scan(documents, columns, f"doc_id {id_type}, source {source_type}, size bigint, word_chars bigint", each)
    rows = rows.withColumn("key", key_of(F.col("doc_id"), quality_of(F.col("size"), F.col("word_chars")), seed))
    return rows.select("doc_id", "source", part_of(F.col("source")).alias("part"), "size", "key", slice_of("key").alias("slice"))


def slice_of(key: str) -> Column:
    return F.least(F.lit(SLICES - 1), F.floor((1 - F.exp(-F.col(key))) * SLICES)).cast("int")


def targets(rows: DataFrame, weights=WEIGHTS, multiple: int = MULTIPLE) -> DataFrame:
    """part, source_size, target, epochs and rest: one row for each source."""
    sources = rows.groupBy("part", "source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("bigint")).withColumn("most", multiple * F.col("source_size"))
    filling = W.orderBy(F.col("source_size") / F.col("weight"), F.col("part"))
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    everything = filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sources = sources.withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    sources = sources.withColumn("left_weight", F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing)))
    level = F.col("left_words") / F.col("left_weight")
    level = F.first(F.when(F.col("weight") * level <= F.col("most"), level), ignorenulls=True).over(everything)
    sources = sources.withColumn("target", F.least(F.col("weight") * level, F.col("most").cast("double")))
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("most"))
    sources = sources.withColumn("budget", budget)
    some = F.greatest(F.col("source_size"), F.lit(1))
    return sources.select(
        "part", "source_size", "target", F.floor(F.col("budget") / some).alias("epochs"), (F.col("budget") % some).alias("rest")
    )


def mix(rows: DataFrame, *, whole: bool = False, weights=WEIGHTS, multiple: int = MULTIPLE) -> DataFrame:
    """What the mix takes of each row of measured(): doc_id, size, source_size, target, taken, epochs, key, part."""
    goal = targets(rows, weights, multiple)
    running = W.partitionBy("part").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = rows.groupBy("part", "slice").agg(F.sum("size").alias("words"))
    slices = slices.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).join(goal, "part")
    placed = rows.join(slices, ["part", "slice"])
    ends_here = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    clear = placed.where(~ends_here).withColumn("more", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    by_key = W.partitionBy("part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    last = placed.where(ends_here).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(by_key), F.lit(0)))
    if whole:
        more = F.when(2 * (F.col("rest") - F.col("before")) >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    else:
        more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    both = clear.unionByName(last.withColumn("more", more))
    taken = (F.col("epochs") * F.col("size") + F.col("more")).cast("bigint").alias("taken")
    return both.select("doc_id", "size", "source_size", "target", taken, "epochs", "more", "key", "part")


def mixed_documents(documents: DataFrame, *, seed: int = SEED, weights=WEIGHTS, multiple: int = MULTIPLE) -> DataFrame:
    """The mix itself: every row of the documents, all columns, as many times as it is taken.

    Documents are taken whole. Each source has a last key; texts meet only the short table of
    the sources and are not shuffled."""
    rows = materialize(measured(documents, seed))
    decided = mix(rows, whole=True, weights=weights, multiple=multiple)
    ends = materialize(
        decided.groupBy("part").agg(
            F.first("epochs").alias("_epochs"), F.max(F.when(F.col("more") > 0, F.struct("key", "doc_id", "size"))).alias("_last")
        )
    )

    @F.pandas_udf("struct<size bigint, chars bigint>")
    def counted(texts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        # One text's words at a time: those of a whole batch would take hundreds of megabytes.
        sizes, inside = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.split()
            sizes[i], inside[i] = len(words), sum(map(len, words))
        return pd.DataFrame({"size": sizes, "chars": lengths.to_numpy() - texts.map(len).to_numpy(np.int64) + inside})

    counts = counted(text_bytes(), F.coalesce(F.length("text"), F.lit(0)))
    own = documents.select(record(documents), "doc_id", part_of(F.col("source")).alias("part"), counts.alias("counts"))
    own = own.withColumn("size", F.col("counts.size"))
    own = own.withColumn("key", key_of(F.col("doc_id"), quality_of(F.col("size"), F.col("counts.chars")), seed))
    met = own.join(ends, "part")
    place = F.struct("key", "doc_id", "size")
    copies = F.col("_epochs") + F.when(F.col("_last").isNotNull() & (place <= F.col("_last")) & (F.col("size") > 0), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int")
    repeated = met.select("record", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return repeated.select("record.*")


def _query(spark, sf):
    rows = materialize(measured(table(spark, sf, "documents")))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def _sql() -> str:
    words = r"[^\x20\x09-\x0D]+"
    weights = f"[{', '.join(map(str, WEIGHTS))}]"
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{words}')) AS BIGINT) AS size,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    (CAST('0x' || substr(md5('{SEED}' || coalesce(':' || doc_id, '')), 1, 13) AS BIGINT) + 1) / CAST({1 << 52} AS DOUBLE) AS u
  FROM documents),
keyed AS (SELECT *, -ln(u) / CASE WHEN size > 0 AND chars >= 3 * size AND chars <= 10 * size THEN 2.0 ELSE 1.0 END AS k FROM sized),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, {weights}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)] AS w, {MULTIPLE} * source_size AS most
  FROM sums),
filling AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / CAST(sum(w) OVER rest AS DOUBLE) AS level,
    row_number() OVER rest AS place
  FROM weighed WINDOW before AS (ORDER BY source_size / CAST(w AS DOUBLE), source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY source_size / CAST(w AS DOUBLE), source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goal AS (
  SELECT source, source_size, least(w * (SELECT level FROM filling WHERE w * level <= most ORDER BY place LIMIT 1), CAST(most AS DOUBLE)) AS target, most FROM filling),
budgets AS (SELECT *, CAST(least(floor(target + 0.5), most) AS BIGINT) AS budget, greatest(source_size, 1) AS some FROM goal),
placed AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.budget // b.some AS epochs, b.budget % b.some AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed"""


QUERIES = {"op4_source_mix": Query(_query, _sql)}
