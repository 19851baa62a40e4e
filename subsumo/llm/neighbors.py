"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node. A node is one row: its unit vector in half precision and its nearest
neighbours so far, each new or not. The graph starts with the nearest nodes in blocks of rows that
lie on the same sides of random hyperplanes. An iteration joins neighbours of neighbours: a node's
neighbours and the nodes that have it as a neighbour meet where one of the two is new there, and whoever is
nearer than what the other has becomes its neighbour. A node around which nothing is new asks for no vector. Iterations end when few edges are new. A
query starts at its own node and goes on to the neighbours of the nearest nodes it has not yet
visited, until it has visited all that it keeps. What it ends with is scored by cosine in double
precision on the original vectors. Neighbours, the orders of the start and the nodes that a query keeps grow
with the number of nodes (`sizes`, `orders`). Every vector is in the graph; recall against brute force is a test.

Of the nodes that have one node as a neighbour (a hub), only as many of the nearest meet there as a
node has neighbours; the others still meet elsewhere. This bounds all groups, and what it costs in
recall is part of the measured recall.

Vectors that are null, zero or hold null or non-finite components take no part. Vectors of different
lengths have no cosine: each length is a graph of its own, and a query finds vectors of its length.
Equal vectors all come up as neighbours, smaller ids first. Rows that repeat an id are answered once
for each row's vector. Without candidates a query has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subsumo.llm.common import Query, shuffles_removed, small_batches, table
from subsumo.session import materialize

#: Neighbours of a node and nodes that a query keeps, both for up to FEW nodes.
NEIGHBOURS, BEAM, FEW = 32, 120, 20_000
#: Hyperplane orders for up to FEW nodes, their bits, rows of a block; share of new edges below which iterations end.
ORDERS, PLANES, BLOCK, CHANGED = 8, 16, 2048, 0.005
#: Orders of a larger graph whose neighbours are merged first; blocks of the others then give only what is nearer.
FIRST = 4
SEED = 5


def sizes(count: int) -> tuple[int, int]:
    """Neighbours of a node (4 more for each doubling) and nodes that a query keeps (with the square root)."""
    times = max(1.0, count / FEW)
    return NEIGHBOURS + math.ceil(4 * math.log2(times)), math.ceil(BEAM * math.sqrt(times))


def orders(count: int) -> int:
    """Hyperplane orders: 4 more for each doubling, so that a larger graph does not start so far from its end."""
    return ORDERS + math.ceil(4 * math.log2(max(1.0, count / FEW)))


def usable(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>) and node: a hash of the vector."""
    vector = F.col(vector_column).cast("array<double>")
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    rows = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.transform(vector, lambda x: x + F.lit(0.0)).alias("vector"), fine.alias("fine"))
    return rows.where("fine AND vec_id IS NOT NULL").select("vec_id", "vector", F.xxhash64("vector").alias("node"))


def _halves(vectors: pa.Array) -> Iterator[bytes]:
    """Unit vectors in half precision from arrays of doubles."""
    ends = np.cumsum(vectors.value_lengths().to_numpy())
    for vector in np.split(vectors.flatten().to_numpy(zero_copy_only=False), ends[:-1]):
        vector = vector / np.abs(vector).max()
        yield (vector / np.linalg.norm(vector)).astype(np.float16).tobytes()


def _units(binaries: pa.Array) -> np.ndarray:
    """Unit vectors of one length."""
    return np.frombuffer(b"".join(binaries.to_pylist()), np.float16).reshape(len(binaries), -1).astype(np.float32)


def _lengths(binaries: pa.Array) -> Iterator[np.ndarray]:
    """Places of the vectors of each length."""
    lengths = pc.binary_length(binaries).to_numpy()
    for length in np.unique(lengths):
        yield np.flatnonzero(lengths == length)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node and its unit vector in half precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_halves(batch.column(1)), pa.binary())], names=["node", "unit"])

    return vectors.select("node", "vector").mapInArrow(run, "node bigint, unit binary").groupBy("node").agg(F.min("unit").alias("unit"))


#: A neighbour: how far it is (its cosine, negated, so that arrays sort by nearness), which node, and whether it has met the others.
_NEIGHBOUR = "struct<far: float, v: bigint, new: boolean>"
_FOUND = "node bigint, far float, v bigint"


def _found(node, like, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(-like, pa.float32()), pa.array(v, pa.int64())], names=["node", "far", "v"])


def first_neighbours(nodes: DataFrame, count: int, most: int, turns: range) -> DataFrame:
    """node and neighbours (an array) from each block of rows in the orders (`turns`) of random hyperplanes: those nearer than `least`, a cosine."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places in _lengths(batch.column(1)):
                one = batch.take(pa.array(places))
                unit = _units(one.column(1))
                for turn in turns:
                    planes = np.random.default_rng([SEED, turn]).standard_normal((unit.shape[1], PLANES)).astype(np.float32)
                    code = ((unit @ planes > 0) * (1 << np.arange(PLANES))).sum(axis=1)
                    place = pa.array(code + (turn << PLANES), pa.int64())
                    length = pa.array(np.full(len(places), unit.shape[1]), pa.int32())
                    names = ["node", "unit", "least", "length", "place"]
                    yield pa.RecordBatch.from_arrays([*one.columns, length, place], names=names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                whole = pa.Table.from_batches(waiting).combine_chunks()
                full = rows - rows % BLOCK
                for start in range(0, full, BLOCK):
                    yield from near(whole.slice(start, BLOCK))
                waiting = whole.slice(full).to_batches()
                rows -= full
        if rows > 1:
            yield from near(pa.Table.from_batches(waiting).combine_chunks())

    def near(block: pa.Table) -> Iterator[pa.RecordBatch]:
        units = block.column("unit").combine_chunks()
        for places in _lengths(units):
            if len(places) < 2:
                continue
            node = block.column("node").to_numpy()[places]
            unit = _units(units.take(pa.array(places)))
            least = block.column("least").to_numpy()[places]
            like = unit @ unit.T
            np.fill_diagonal(like, -3)
            nearer = like > least[:, None]
            # Not more than the nearest of a block: where those are all, the cosine of the last of them is the bound.
            crowded = np.flatnonzero(np.count_nonzero(nearer, axis=1) > most)
            if len(crowded):
                these = like[crowded]
                nearer[crowded] = these >= np.partition(these, -most, axis=1)[:, -most, None]
            # A node stands in a block once for each of its orders: a neighbour that is the node itself goes later.
            a, b = np.nonzero(nearer)
            entries = pa.StructArray.from_arrays(
                [pa.array(-like[a, b], pa.float32()), pa.array(node[b], pa.int64()), pa.array(np.ones(len(a), bool))], names=["far", "v", "new"]
            )
            counts = np.bincount(a, minlength=len(node))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), entries)
            some = pa.array(np.flatnonzero(counts))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()).take(some), lists.take(some)], names=["node", "neighbours"])

    # The driver gets a sample of the rows for each of these parts.
    parts = max(1, count * len(turns) // (8 * BLOCK))
    parts = min(parts, max(2000, parts // 8))
    placed = nodes.select("node", "unit", "least").mapInArrow(codes, "node bigint, unit binary, least float, length int, place bigint")
    ordered = placed.repartitionByRange(parts, "length", "place", "node").sortWithinPartitions("length", "place", "node")
    return ordered.select("node", "unit", "least").mapInArrow(blocks, f"node bigint, neighbours array<{_NEIGHBOUR}>")


def _far_key(row: np.ndarray, far: np.ndarray) -> np.ndarray:
    """One number by which rows and, in them, distances order."""
    bits = (far + np.float32(0)).view(np.uint32)
    bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    return (row.astype(np.uint64) << np.uint64(32)) | bits


def _by_distance(row: np.ndarray, far: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The order by row, far and v, as lexsort has it, from one sort of numbers; v decides for the few that are equal."""
    key = _far_key(row, far)
    order = np.argsort(key)
    key = key[order]
    tie = np.zeros(len(key) + 1, bool)
    tie[1:-1] = key[1:] == key[:-1]
    tied = np.flatnonzero(tie[1:] | tie[:-1])
    order[tied] = order[tied][np.lexsort((v[order[tied]], key[tied]))]
    return order


def _by_node(row: np.ndarray, v: np.ndarray, new: np.ndarray, far: np.ndarray) -> np.ndarray:
    """An order in which equal nodes of a row stand together, those that are not new first."""
    if len(row) and row[-1] < 1 << 18:
        low = v.astype(np.uint64) & np.uint64((1 << 44) - 1)
        key = (row.astype(np.uint64) << np.uint64(45)) | (low << np.uint64(1)) | new
        order = np.argsort(key)
        key = key[order] >> np.uint64(1)
        if not np.any((key[1:] == key[:-1]) & (v[order[1:]] != v[order[:-1]])):
            return order
    return np.lexsort((far, new, v, row))


def nearest(rows: DataFrame, most: int) -> DataFrame:
    """Cuts `neighbours`, the last column of rows with `node`, to the `most` nearest: each once, as not new if it is so anywhere."""
    own = rows.columns.index("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            far, v = flat.field("far").to_numpy(), flat.field("v").to_numpy()
            new = flat.field("new").to_numpy(zero_copy_only=False)
            order = _by_node(row, v, new, far)
            row, far, v, new = row[order], far[order], v[order], new[order]
            once = v != batch.column(own).to_numpy()[row]
            once[1:] &= (row[1:] != row[:-1]) | (v[1:] != v[:-1])
            row, far, v, new = row[once], far[once], v[once], new[once]
            order = _by_distance(row, far, v)
            row, far, v, new = row[order], far[order], v[order], new[order]
            counts = np.bincount(row, minlength=len(lists))
            kept = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < most
            entries = pa.StructArray.from_arrays([pa.array(far[kept]), pa.array(v[kept]), pa.array(new[kept])], names=["far", "v", "new"])
            ends = np.concatenate([[0], np.cumsum(np.minimum(counts, most))])
            cut = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cut], names=batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def least_of(most: int) -> Column:
    """The cosine that a neighbour must beat."""
    return F.when(F.size("neighbours") >= most, -F.element_at("neighbours", -1).far).otherwise(F.lit(-2.0)).cast("float").alias("least")


def first_graph(nodes: DataFrame, count: int, most: int) -> DataFrame:
    """node, unit, neighbours of all nodes. In larger graphs blocks of later orders leave out what the first orders have nearer."""
    turns = orders(count)
    edges = nodes.select("node", "unit", F.array().cast(f"array<{_NEIGHBOUR}>").alias("neighbours"))
    for some in (range(turns),) if turns <= ORDERS else (range(FIRST), range(FIRST, turns)):
        if some.start:
            edges = materialize(edges)
        lists = first_neighbours(edges.select("node", "unit", least_of(most)), count, most, some)
        lists = lists.groupBy("node").agg(F.flatten(F.collect_list("neighbours")).alias("all"))
        both = F.concat("neighbours", F.coalesce("all", F.array().cast(f"array<{_NEIGHBOUR}>")))
        edges = nearest(edges.join(lists.hint("merge"), "node", "left").select("node", "unit", both.alias("neighbours")), most)
    return edges


def both_ways(edges: DataFrame, most: int) -> DataFrame:
    """node, unit and `around`: neighbours of a node and, of the nodes that have it as a neighbour, as many of the nearest."""
    each = edges.select(F.col("node").alias("u"), F.explode("neighbours").alias("x"))
    back = each.select(F.col("x.v").alias("node"), F.struct("x.far", F.col("u").alias("v"), "x.new").alias("x"))
    place = F.row_number().over(W.partitionBy("node").orderBy("x"))
    back = back.withColumn("place", place).where(F.col("place") <= most).groupBy("node").agg(F.collect_list("x").alias("back"))
    all_of_them = F.concat("neighbours", F.coalesce("back", F.array().cast(f"array<{_NEIGHBOUR}>")))
    joined = edges.join(back.hint("merge"), "node", "left").select("node", "unit", all_of_them.alias("neighbours"))
    return nearest(joined, 2 * most).withColumnRenamed("neighbours", "around")


def asked(edges: DataFrame, most: int) -> DataFrame:
    """at, node, new: whom nodes around which something is new let meet. Others ask for nobody, so iterations shrink."""
    around = both_ways(edges, most).where(F.exists("around", lambda x: x.new))
    return around.select(F.col("node").alias("at"), F.explode("around").alias("x")).select("at", F.col("x.v").alias("node"), "x.new")


def descend(edges: DataFrame, most: int) -> DataFrame:
    """The graph after one iteration: where one of two neighbours of a node is new there, they meet. What they gain is new."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            members = lists.flatten()
            node = members.field("node").to_numpy()
            units = members.field("unit")
            least = members.field("least").to_numpy()
            new = members.field("new").to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            found: list[tuple] = []
            for start, end in zip(np.concatenate([[0], ends[:-1]]), ends):
                unit = _units(units.slice(start, end - start))
                like = unit @ unit.T
                fresh = new[start:end]
                # Worth a row where it beats the worst neighbour that a has.
                a, b = np.nonzero((like > least[start:end, None]) & (fresh[:, None] | fresh))
                found.append((node[start + a], like[a, b], node[start + b]))
            a, like, b = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((b, a))
            a, like, b = a[order], like[order], b[order]
            first = a != b
            first[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield _found(a[first], like[first], b[first])

    members = asked(edges, most).join(edges.select("node", "unit", least_of(most)).hint("merge"), "node")
    groups = members.groupBy("at").agg(F.collect_list(F.struct("node", "unit", "least", "new")).alias("members"))
    gains = groups.select("members").mapInArrow(meet, _FOUND)
    gained = gains.groupBy("node").agg(F.collect_list(F.struct("far", "v", F.lit(True).alias("new"))).alias("gained"))
    were = F.transform("neighbours", lambda x: F.struct(x.far.alias("far"), x.v.alias("v"), F.lit(False).alias("new")))
    both = F.concat(were, F.coalesce("gained", F.array().cast(f"array<{_NEIGHBOUR}>")))
    return nearest(edges.join(gained.hint("merge"), "node", "left").select("node", "unit", both.alias("neighbours")), most)


def _written(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """The graph as a table, its edges and its new ones, counted while it is written."""
    seen = Observation()
    edges = materialize(edges.observe(seen, F.sum(F.size("neighbours")).alias("all"), F.sum(F.size(F.filter("neighbours", lambda x: x.new))).alias("new")))
    return edges, seen.get["all"] or 0, seen.get["new"] or 0


def graph(nodes: DataFrame, count: int, changed: float = CHANGED) -> DataFrame:
    """node, unit and neighbours, iterated until the share of new ones is at most `changed`."""
    most, _ = sizes(count)
    edges, total, new = _written(first_graph(nodes, count, most))
    while new > changed * total:
        edges, total, new = _written(descend(edges, most))
    return edges


#: Nodes whose vectors a task of the search holds at a time; slots there are at least, if nodes are enough; visits that are sent to all tasks.
HELD, SLOTS, SENT = 32_768, 24, 20_000
#: More than half precision and sums in single precision can take from one cosine and add to another.
MARGIN = 2.0**-8
_KEPT = "array<struct<far: float, node: bigint, visited: boolean>>"


def slots_of(count: int) -> int:
    """Parts of the nodes whose vectors tasks of the search hold."""
    return math.ceil(max(count / HELD, min(count / 2048, SLOTS), 1))


def fresh(met: DataFrame, slots: int, keep: int) -> DataFrame:
    """slot, id, vector, worst, nodes: a query's `met` nodes that it does not keep, each once, by their slot, with what they must beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, lists = batch.column(2), batch.column(3)
            far, own = kept.flatten().field("far").to_numpy(), kept.flatten().field("node").to_numpy()
            kept_ends, ends = (np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for x in (kept, lists))
            met = lists.flatten().to_numpy()
            rows, slot, nodes, sizes_, worst = [], [], [], [], []
            for row in range(batch.num_rows):
                mine = slice(kept_ends[row], kept_ends[row + 1])
                one = np.setdiff1d(met[ends[row] : ends[row + 1]], own[mine])
                place = one % slots
                order = np.argsort(place, kind="stable")
                counts = np.bincount(place, minlength=slots)
                at = np.flatnonzero(counts)
                rows.append(np.full(len(at), row))
                slot.append(at)
                nodes.append(one[order])
                sizes_.append(counts[at])
                worst.append(far[mine][-1] if mine.stop - mine.start >= keep else np.float32(np.inf))
            row = np.concatenate(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes_))]), pa.int32()), pa.array(np.concatenate(nodes), pa.int64()))
            columns = [pa.array(np.concatenate(slot), pa.int64()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.array(worst, np.float32)[row]), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "id", "vector", "worst", "nodes"])

    return met.select("query", "own", "kept", "met").mapInArrow(run, "slot bigint, id bigint, vector binary, worst float, nodes array<bigint>")


def scored(asks: DataFrame, units: DataFrame, slots: int) -> DataFrame:
    """query and `more`: the asked nodes that are nearer than the query's worst. A task reads a slot's vectors once, then what asks for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, asking = batch.column(0).to_numpy(), batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((slot[1:] != slot[:-1]) | (asking[1:] != asking[:-1])) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(slot)]):
                part = batch.slice(start, end - start)
                if slot[start] != at:
                    at, waiting, held = slot[start], [], None
                if asking[start]:
                    held = held or hold(waiting)
                    yield from answers(*held, part)
                else:
                    waiting.append(part)

    def hold(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Ids in order, the places of their vectors among those of the same length, and these."""
        whole = pa.Table.from_batches(parts).combine_chunks()
        vectors = whole.column("vector").combine_chunks()
        place, units = np.empty(len(vectors), np.int64), {}
        for places in _lengths(vectors):
            place[places] = np.arange(len(places))
            units[len(vectors[int(places[0])].as_py())] = _units(vectors.take(pa.array(places)))
        return whole.column("id").to_numpy(), place, units

    def answers(ids: np.ndarray, place: np.ndarray, units: dict[int, np.ndarray], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for places in _lengths(part.column(2)):
            one = part.take(pa.array(places))
            own, lists = one.column(2), one.column(4)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            node = lists.flatten().to_numpy()
            unit, mine = units[len(own[0].as_py())], _units(own)
            there = place[np.searchsorted(ids, node)]
            far = np.empty(len(node), np.float32)
            for start in range(0, len(node), 8192):
                some = slice(start, start + 8192)
                far[some] = -np.einsum("ij,ij->i", mine[row[some]], unit[there[some]])
            near = far < one.column(3).to_numpy()[row]
            far, node, counts = far[near], node[near], np.bincount(row[near], minlength=len(lists))
            entries = pa.StructArray.from_arrays([pa.array(far), pa.array(node), pa.array(np.zeros(len(node), bool))], names=["far", "node", "visited"])
            more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), entries)
            some = pa.array(np.flatnonzero(counts))
            yield pa.RecordBatch.from_arrays([one.column(1).take(some), more.take(some)], names=["query", "more"])

    none = (F.lit(None).cast("float").alias("worst"), F.lit(None).cast("array<bigint>").alias("nodes"))
    held = units.select(F.pmod("node", F.lit(slots)).alias("slot"), F.col("node").alias("id"), F.col("unit").alias("vector"), *none)
    dealt = held.unionAll(asks).repartition(slots, "slot").sortWithinPartitions("slot", F.col("nodes").isNotNull(), "id")
    return dealt.mapInArrow(run, f"query bigint, more {_KEPT}")


def search(queries: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """query (a node) and node: of the nodes that a greedy search from the query's own node ends with,
    those that may be among its `wanted` nearest (a column of queries) in double precision.

    Pairs of a query and a node that it meets travel as ids; vectors of nodes stay in slots. Joins are told
    how to go: sizes after an explode are not known to Spark, and what it takes for small it sends through the driver."""
    most, keep = sizes(count)
    slots = slots_of(count)

    def write(state: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        state = materialize(state.observe(seen, F.sum(F.size(F.filter("kept", lambda x: ~x.visited))).alias("open")))
        return state, seen.get["open"] or 0

    around = materialize(both_ways(edges, most).select("node", F.col("around.v").alias("around")))
    units = edges.select("node", "unit")
    own = F.array(F.struct(F.lit(-1.0).cast("float").alias("far"), F.col("node").alias("node"), F.lit(False).alias("visited")))
    start = queries.select(F.col("query").alias("node"), "wanted").join(units.hint("merge"), "node")
    state, left = write(start.select(F.col("node").alias("query"), F.col("unit").alias("own"), "wanted", own.cast(_KEPT).alias("kept")))
    # A step visits all that a query keeps and has not visited; each node once, as what is dropped never comes back: so there is an end.
    visited = F.transform("kept", lambda x: F.struct(x.far.alias("far"), x.node.alias("node"), F.lit(True).alias("visited")))
    none_met = F.lit(None).cast("array<bigint>").alias("around")
    while left:
        visits = state.select("query", F.explode(F.filter("kept", lambda x: ~x.visited).getField("node")).alias("node"))
        lists = visits.hint("broadcast" if left <= SENT else "merge").join(around, "node").select("query", "around")
        # A query's row and what it meets come together in one exchange.
        met = state.select("query", "own", "kept", none_met).unionByName(lists, allowMissingColumns=True).groupBy("query")
        met = met.agg(F.max("own").alias("own"), F.flatten(F.collect_list("kept")).alias("kept"), F.flatten(F.collect_list("around")).alias("met"))
        more = scored(fresh(met, slots, keep), units, slots).withColumnRenamed("more", "kept")
        rows = state.select("query", "own", "wanted", visited.alias("kept")).unionByName(more, allowMissingColumns=True).groupBy("query")
        rows = rows.agg(F.max("own").alias("own"), F.max("wanted").alias("wanted"), F.flatten(F.collect_list("kept")).alias("kept"))
        state, left = write(rows.withColumn("kept", F.slice(F.array_sort("kept"), 1, keep)))
    last = F.element_at("kept", F.least(F.size("kept"), "wanted")).far
    return state.select("query", F.explode(F.filter("kept", lambda x: x.far <= last + MARGIN).getField("node")).alias("node"))


def cosine(a: Column, b: Column) -> Column:
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    return dot / (F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x))))


def nearest_neighbours(rows: DataFrame, *, is_query: Column, most: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query row; is_query is over vec_id."""
    vectors = materialize(usable(rows, id_column, vector_column))
    nodes = materialize(nodes_of(vectors))
    asked = vectors.where(is_query)
    count = nodes.count()
    # So many nodes hold at least `most` rows of other ids: an id with several vectors takes its own out of as many nodes.
    several = asked.select("vec_id", "node").distinct().withColumn("several", F.count("*").over(W.partitionBy("vec_id")))
    wanted = several.groupBy(F.col("node").alias("query")).agg((F.max("several") + most).cast("int").alias("wanted"))
    with small_batches(rows.sparkSession), shuffles_removed(rows.sparkSession):
        found = search(wanted, graph(nodes, count), count)
    # Of equal vectors only the smallest ids can be among the nearest, besides the query's own.
    by_id = W.partitionBy("node").orderBy("vec_id")
    members = vectors.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= most + 1).drop("place")
    queries = asked.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("own"))
    met = queries.join(found.hint("merge"), "query").join(members.hint("merge"), "node").where("vec_id <> query_id")
    scored = met.select("query_id", "query", "vec_id", cosine(F.col("own"), F.col("vector")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


QUERIES = {
    "op7_nearest_neighbours": Query(
        lambda spark, sf: nearest_neighbours(table(spark, sf, "embeddings"), is_query=F.col("vec_id") % 50 == 0)
    )
}
