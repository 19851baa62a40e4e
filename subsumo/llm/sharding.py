"""Sharding: a two-pass external shuffle into shards of equal row counts.

The first pass scatters the records by a seeded hash into buckets. Their number follows from
the bytes of the whole table, so a bucket fits in memory whatever the table's size. The hash
covers a record's place in the input, so that copies scatter too and no bucket is hot. The
second pass draws a Fisher-Yates permutation of each bucket and writes it. The buckets one
after another are a random order of the table; shard s of n has the places from s/n to (s+1)/n.

The law is `rows`: counts of shards differ by one at most. Places are counted on the written
table, so that reruns of lost tasks cannot change them. Null texts have no bytes (crc32 0);
rows that repeat are records of their own; an empty table gives no rows. All other columns
go along unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subsumo.llm.common import Query, table, text_bytes
from subsumo.session import materialize

SHARDS, SEED = 8, 11
#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 16 << 20
#: Most buckets whose offsets are broadcast (of 32 bytes). More of them meet the records in a join that shuffles.
BROADCAST_BUCKETS = 1 << 20


def size_of(text: Column) -> Column:
    return (F.length(text_bytes(text)) + 1).cast("bigint")


def shuffled(records: DataFrame, *, text_column: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """bucket, place (in the bucket) and record (all columns) in random order, as a written table."""
    total = records.agg(F.sum(size_of(F.col(text_column)))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    mark = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    record = F.struct(*(F.col(c) for c in records.columns))
    scattered = records.select(F.pmod(mark, F.lit(buckets)).cast("int").alias("bucket"), mark.alias("mark"), record.alias("record"))
    gathered = scattered.groupBy("bucket").agg(F.collect_list("mark").alias("marks"), F.collect_list("record").alias("rows"))
    # Sorted by mark first, since rows arrive in any order; then permuted (Spark's shuffle is a Fisher-Yates draw).
    # Both lists have one order. Records are not compared, so they may hold maps.
    numbers = F.transform("marks", lambda mark, i: F.struct(mark.alias("mark"), i.alias("i")))
    ordered = gathered.sortWithinPartitions("bucket").select("bucket", "rows", F.sort_array(numbers).alias("drawn"))
    permuted = ordered.select("bucket", "rows", F.shuffle(F.col("drawn"), seed).alias("drawn"))
    records_ = F.transform("drawn", lambda x: F.get("rows", x["i"]))
    return materialize(permuted.select("bucket", F.posexplode(records_).alias("place", "record")))


def with_shards(written: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot to the rows of a written random order."""
    counts = materialize(written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    in_order = W.orderBy("bucket")
    offsets = counts.select(
        "bucket",
        (F.sum("n").over(in_order) - F.col("n")).alias("offset"),
        F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    if counts.count() <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    placed = written.join(offsets, "bucket").withColumn("at", F.col("offset") + F.col("place"))
    placed = placed.withColumn("shard", F.expr(f"CAST(at * {shards} DIV total AS INT)"))
    first = F.expr(f"(shard * total + {shards - 1}) DIV {shards}")
    return placed.withColumn("slot", (F.col("at") - first).cast("bigint")).drop("at", "offset", "total", "place", "bucket")


def shard_records(records: DataFrame, *, text_column: str = "text", shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """record (a struct of all columns), shard and slot of every record."""
    return with_shards(shuffled(records, text_column=text_column, bucket_bytes=bucket_bytes, seed=seed), shards)


def write_shards(records: DataFrame, folder: str, **options) -> None:
    """Parquet folders by shard, rows in the order of their slots within each file."""
    placed = shard_records(records, **options)
    columns = [F.col("record")[c].alias(c) for c in records.columns]
    spread = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    spread.select(*columns, F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(folder)


def _query(spark, sf):
    placed = shard_records(table(spark, sf, "documents"))
    text = F.col("record.text")
    return placed.select(
        F.col("record.doc_id").alias("doc_id"), size_of(text).alias("size"), F.crc32(text_bytes(text)).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_external_shuffle": Query(_query)}
