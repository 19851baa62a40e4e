"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a size-aware join.

Sets that are equal are one class; only classes are joined. Shingles are put in an order of
rising frequency (by counters over the whole corpus), so that a class needs to be found by
few, rare shingles only: of n shingles in that order, the first n - ceil(0.8 n) + k hold at
least k shingles of every partner's first ones. Light sets (few shingles) are found by all
subsets of size 2 of their first shingles, heavy sets by scanning the inverted lists of
single first shingles. The boundary is the size at which the estimated costs of both are least:
subsets are counted by size, and lists are as long as the counters say. Light sets near the
boundary are in the lists too, since their partners may be heavy.

Members of a list are first compared with one of them, the list's leader. What agrees is one
component; pairs inside a component need no look, since only the component is asked for.
Lists that still hold several components have all pairs between different components
compared. Each comparison is exact on whole sets (64-bit hashes of shingles). Every link
between different components is found; no list is capped.

Sets: words are lower-cased (A-Z); with fewer words than a shingle the whole sequence is
one shingle. Null and empty texts have no set and link with nothing. Rows with equal ids are
documents of their own. A null id never is a component's id unless all its ids are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subsumo.llm import counters
from subsumo.llm.common import SPACES, Query, ascii_lower, mixed, pieces, record, shuffles_removed, small_batches, table, text_bytes, window_hashes, word_hashes
from subsumo.llm.components import components
from subsumo.session import materialize

#: Words of a shingle; least similarity as a fraction; size of the subsets of light sets.
WIDTH, LEAST, OF, SUBSET = 5, 4, 5, 2
#: Rounds in which lists compare with a leader only.
LEADER_ROUNDS = 1


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted set of hashed shingles of a text."""
    return np.unique(window_hashes(word_hashes(ascii_lower(text).split()), width))


def class_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_key(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


def _need(n):
    """The fewest shingles that a set of n shares with a partner."""
    return -(-LEAST * n // OF)


# --- what is known of each document -----------------------------------------------------


def profiles(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n, node (class) and text_key by document; and pieces of the counters of shingles."""
    id_type = documents.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        id_arrow = None
        for batch in pieces(batches):
            id_arrow = batch.schema.field(0).type
            n, nodes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                n.append(len(found))
                nodes.append(class_of(found) if len(found) else None)
                keys.append(text_key(text))
                np.add.at(counts, counters.buckets(found, width), 1)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())],
                names=["doc_id", "n", "node", "text_key", "chunk", "counts"],
            )
        if id_arrow is not None:
            for chunk, piece in counters.chunk_rows(counts):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, id_arrow), *(pa.array([None], pa.int64()) for _ in range(3)), pa.array([chunk], pa.int32()), pa.array([piece], pa.binary())],
                    names=["doc_id", "n", "node", "text_key", "chunk", "counts"],
                )

    schema = f"doc_id {id_type.simpleString()}, n bigint, node bigint, text_key bigint, chunk int, counts binary"
    return documents.select("doc_id", text_bytes().alias("text")).mapInArrow(run, schema)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Coarse levels of frequency, one byte a counter."""
    return np.minimum(255, np.floor(4 * np.log2(counts + 1))).astype(np.uint8)


def _parity(found: np.ndarray, bits: int) -> np.ndarray:
    """Bit i tells whether an odd number of shingles fall on it; two sets differ in as many shingles at least as their bits do."""
    odd = (np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _parity_bits(n: int) -> int:
    return max(128, 1 << int(n - 1).bit_length())


def signatures(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """node, n, first (the first shingles in the order), listed (estimated rows to scan) and parity."""
    width, levels = len(counts), levels_of(counts)
    # What a counter holds of other shingles, on average, is not the shingle's.
    lengths = np.maximum(1, counts - int(counts.mean())).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                key = text_key(text)
                if key in seen:
                    continue
                seen.add(key)
                found = shingles(text)
                n = len(found)
                if n * OF // LEAST <= n:
                    continue  # equal sets are the only partners
                at = counters.buckets(found, width)
                order = np.argsort(levels[at], kind="stable")[: n - _need(n) + SUBSET]
                parity = _parity(found, _parity_bits(n))
                rows.append((class_of(found), n, found[order].view(np.int64), float(lengths[at[order[: n - _need(n) + 1]]].sum()), parity))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "n", "first", "listed", "parity"]
            )

    schema = "node bigint, n bigint, first array<bigint>, listed double, parity array<bigint>"
    found = documents.select(text_bytes().alias("text")).mapInArrow(run, schema)
    return found.dropDuplicates(["node"])


def boundary(signed: DataFrame) -> int:
    """The largest size of light sets: the sum of subsets up to it and of lists beyond it is least."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(OF / LEAST))).cast("int")
    k = F.size("first")
    # One row for each step of sizes by a quarter: about a hundred at most.
    costs = signed.groupBy(step.alias("step")).agg(
        F.max("n").alias("most"), F.sum((k * (k - 1) / 2).cast("double")).alias("subsets"), F.sum("listed").alias("lists")
    )
    rows = sorted(costs.collect(), key=lambda r: r["step"])
    best, least = 0, sum(r["lists"] for r in rows)
    for i, row in enumerate(rows):
        near = rows[i]["lists"] + (rows[i - 1]["lists"] if i else 0)
        cost = sum(r["subsets"] for r in rows[: i + 1]) + sum(r["lists"] for r in rows[i + 1 :]) + near
        if cost < least:
            best, least = row["most"], cost
    return best


def postings(signed: DataFrame, light: int, counts: np.ndarray, cold: int) -> DataFrame:
    """key, node, n, hot: the inverted lists. A list that is not hot has at most `cold` rows."""
    width, counts = len(counts), np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            keys, nodes, sizes, often = [], [], [], []
            firsts = batch.column("first")
            for i, (node, n) in enumerate(zip(batch.column("node").to_pylist(), batch.column("n").to_pylist())):
                first = firsts[i].values.to_numpy().view(np.uint64)
                listed = counts[counters.buckets(first, width)]
                own, length = [], []
                if n <= light:
                    a, b = np.triu_indices(len(first), 1)
                    low, high = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
                    own.append(mixed(low * np.uint64(0x9E3779B97F4A7C15) + high))
                    length.append(np.minimum(listed[a], listed[b]))
                if OF * n > LEAST * light:
                    single = n - _need(n) + 1
                    own.append(first[:single])
                    length.append(listed[:single])
                keys.append(np.concatenate(own))
                often.append(np.concatenate(length) > cold)
                nodes.append(np.full(len(keys[-1]), node, np.int64))
                sizes.append(np.full(len(keys[-1]), n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (*([k.view(np.int64) for k in keys],), nodes, sizes, often)], names=["key", "node", "n", "hot"]
                )

    return signed.select("node", "n", "first").mapInArrow(run, "key bigint, node bigint, n int, hot boolean")


def shared_lists(posted: DataFrame) -> DataFrame:
    """key, node, n of lists with more than one member; hot lists are taken to have more."""
    alone = F.count(F.lit(1)).over(W.partitionBy("key"))
    cold = posted.where("not hot").withColumn("members", alone).where("members > 1")
    return cold.select("key", "node", "n").unionByName(posted.where("hot").select("key", "node", "n"))


# --- comparisons --------------------------------------------------------------------------


def involved_sets(documents: DataFrame, profiled: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and its whole set (sorted 64-bit hashes as bytes), for the given nodes."""
    keys = profiled.where("node IS NOT NULL").groupBy("node").agg(F.min("text_key").alias("text_key")).join(nodes, "node", "left_semi")
    keys = materialize(keys)
    wanted = counters.counted(keys.select("text_key"), width) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                key = text_key(text)
                if key not in seen and wanted[counters.buckets(np.array([key], np.int64).view(np.uint64), width)[0]]:
                    seen.add(key)
                    rows.append((key, shingles(text).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], names=["text_key", "set"]
                )

    found = documents.select(text_bytes().alias("text")).mapInArrow(run, "text_key bigint, set binary")
    return found.dropDuplicates(["text_key"]).join(keys, "text_key").select("node", "set")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v and whether they link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            links = []
            for a, b in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                links.append(OF * common >= LEAST * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(links, pa.bool_())], names=["u", "v", "links"])

    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u")
    met = met.join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v")
    return met.select("u", "v", "set_u", "set_v").mapInArrow(run, "u bigint, v bigint, links boolean")


def _near_sizes(a: Column, b: Column) -> Column:
    return (OF * a >= LEAST * b) & (OF * b >= LEAST * a)


def open_lists(shared: DataFrame, comps: DataFrame | None) -> DataFrame:
    """key, node, n, comp of lists that hold more than one component."""
    if comps is None:
        return shared.withColumn("comp", F.col("node"))
    placed = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return placed.join(several.select("key"), "key", "left_semi").select("key", "node", "n", "comp")


def _folded(parity: Column) -> Column:
    """The parity for half the bits."""
    half = F.floor(F.size(parity) / 2).cast("int")
    return F.zip_with(F.slice(parity, F.lit(1), half), F.slice(parity, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _may_link(a: str, b: str) -> Column:
    """What sizes and parities allow; columns n_ and parity_ with the given endings."""
    n_a, n_b, parity_a, parity_b = (F.col(f"{c}_{end}") for c in ("n", "parity") for end in (a, b))
    # Sizes differ by a quarter at most, so the numbers of bits are equal or one is the double.
    left = F.when(F.size(parity_a) > F.size(parity_b), _folded(parity_a)).otherwise(parity_a)
    right = F.when(F.size(parity_b) > F.size(parity_a), _folded(parity_b)).otherwise(parity_b)
    bits = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return _near_sizes(n_a, n_b) & F.coalesce(bits * (LEAST + OF) <= (n_a + n_b) * (OF - LEAST), F.lit(True))


def leader_pairs(lists: DataFrame, signed: DataFrame, turn: int) -> DataFrame:
    """u, v: for each node the leader that most of its lists have, of another component."""
    leaders = lists.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("comp").alias("comp_v"))).alias("leader")
    )
    met = lists.join(leaders, "key").select("node", "n", "comp", "leader.*")
    votes = met.where((F.col("comp") != F.col("comp_v")) & _near_sizes(F.col("n"), F.col("n_v"))).groupBy("node", "v").agg(F.count(F.lit(1)).alias("votes"))
    for end, column in (("u", "node"), ("v", "v")):
        own = signed.select(F.col("node").alias(column), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "parity")))
        votes = votes.join(own, column)
    votes = votes.where(_may_link("u", "v")).select("node", "v", "votes")
    best = votes.groupBy("node").agg(F.max(F.struct("votes", "v")).alias("best"))
    return best.select(F.greatest("node", "best.v").alias("u"), F.least("node", "best.v").alias("v")).distinct()


def token_lists(lists: DataFrame, signed: DataFrame) -> DataFrame:
    """key, at, node, n, comp, parity: lists of single first shingles of what is in open lists.

    Only lists with several components are kept; `at` is the shingle's place in the order."""
    nodes = lists.groupBy("node").agg(F.first("comp").alias("comp"))
    single = (F.col("n") - F.ceil(F.col("n") * LEAST / OF) + 1).cast("int")
    rows = signed.join(nodes, "node").select("node", "n", "comp", F.posexplode(F.slice("first", F.lit(1), single)).alias("at", "key"))
    several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    rows = rows.join(several.select("key"), "key", "left_semi")
    return rows.join(signed.select("node", "parity"), "node")


def all_pairs(lists: DataFrame, signed: DataFrame) -> DataFrame:
    """u, v: all pairs of nodes of different components in a list that may link by size, place and parity.

    The first shingle that two sets have in common leaves the rest of each for the others,
    so in a list where a pair meets too late to reach its overlap it has met before or never."""
    full = token_lists(lists, signed)
    columns = ("node", "n", "at", "comp", "parity")
    a, b = (full.select("key", *(F.col(c).alias(f"{c}_{end}") for c in columns)) for end in ("a", "b"))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = rest * (LEAST + OF) >= LEAST * (F.col("n_a") + F.col("n_b"))
    may = (F.col("node_a") > F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & enough & _may_link("a", "b")
    met = a.join(b, (a["key"] == b["key"]) & may)
    return met.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct()


# --- the join -------------------------------------------------------------------------------


def similar_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    with shuffles_removed(documents.sparkSession), small_batches(documents.sparkSession):
        return with_components(*_joined(documents.select("doc_id", "text")))


def _joined(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is known of each document, and the components of classes, as written tables."""
    # Some counters for each document, a million (8 MB) at most.
    width = 1 << min(20, max(16, 2 + int(documents.count()).bit_length()))
    known = materialize(profiles(documents, width))
    counts = counters.added(known.where("chunk IS NOT NULL"), width)
    profiled = known.where("chunk IS NULL")

    signed = materialize(signatures(documents, counts))
    cold = 1000 + 4 * int(counts.mean())
    shared = materialize(shared_lists(postings(signed, boundary(signed), counts, cold)))
    links, tried, comps = None, None, None
    for turn in range(LEADER_ROUNDS + 1):
        # Lists that are one component stay so and drop out.
        shared = lists = materialize(open_lists(shared, comps)) if comps is not None else open_lists(shared, None)
        shared = shared.drop("comp")
        pairs = leader_pairs(lists, signed, turn) if turn < LEADER_ROUNDS else all_pairs(lists, signed)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"))
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        compared = materialize(linked(pairs, materialize(involved_sets(documents, profiled, nodes, width))))
        tried = compared.select("u", "v") if tried is None else tried.unionByName(compared.select("u", "v"))
        found = compared.where("links").select("u", "v")
        links = found if links is None else links.unionByName(found)
        comps = materialize(components(links))
    return profiled, comps


def with_components(profiled: DataFrame, comps: DataFrame) -> DataFrame:
    least = profiled.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id")).join(comps, "node", "left")
    least = least.withColumn("comp", F.coalesce("comp", "node"))
    named = least.join(least.groupBy("comp").agg(F.min("first_id").alias("component_id")), "comp").select("node", "component_id")
    out = profiled.join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """All columns of one row of each component: the one with the smallest id, null ids last.

    A row is known by its id and its text, so different texts of one id are rows of their own and
    null ids are told apart. Of rows that repeat one stays; rows without a shingle all stay."""
    known = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    with shuffles_removed(documents.sparkSession), small_batches(documents.sparkSession):
        found = with_components(*_joined(documents.select(known.alias("doc_id"), "text")))
    kept = found.where((F.col("n_shingles") > 0) & (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("key")).distinct()
    some = F.coalesce("text", F.lit("")).rlike(f"[^{SPACES}]")
    named = documents.where(some).select(known.alias("key"), record(documents)).join(kept, "key", "left_semi").dropDuplicates(["key"])
    return named.select("record.*").unionByName(documents.where(~some))


def _sql() -> str:
    return r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words),
sets AS (SELECT DISTINCT doc_id, s FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT u AS doc_id, u AS other FROM links UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT doc_id, min(least(doc_id, other)) AS component_id FROM reached GROUP BY doc_id) r USING (doc_id)"""


QUERIES = {"op1_jaccard_join": Query(lambda spark, sf: similar_documents(table(spark, sf, "documents")), _sql)}
