"""Operators over whole tables, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_samples import DOCUMENTS, LABELS, PROSE, odd_rows
from pyspark.sql import functions as F

from subsumo.llm import jaccard, mixing, neighbors, sharding
from subsumo.llm.components import components

# --- Jaccard join -------------------------------------------------------------------------


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [plain_set(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                comp[root(i)] = root(j)
    least = defaultdict(list)
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)].append(row[0])
    return [(r[0], len(sets[i]), min(least[root(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows)]


def near_copies(seed, n):
    """Families of texts with a few words changed, sharing passages, of many sizes."""
    draw = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(n):
        base = [f"f{family}w{draw.randint(0, 50)}" for _ in range(draw.choice([3, 4, 5, 8, 12, 20, 60, 150, 400]))]
        if family % 3 == 0:
            base = base + passage
        for _ in range(draw.randint(1, 6)):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(text) // 40))):
                text[draw.randrange(len(text))] = f"x{draw.random()}"
            rows.append((len(rows), " ".join(text), "en", "s", 1))
    draw.shuffle(rows)
    return rows


def compare(spark, rows):
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()]
    assert Counter(found) == Counter(plain_components(rows))


def test_jaccard_join(spark):
    compare(spark, near_copies(1, 60))


def test_jaccard_chains(spark):
    """Each text is near the next one only."""
    words = [f"w{i}" for i in range(400)]
    compare(spark, [(i, " ".join(words[i * 8 : i * 8 + 100]), "en", "s", 1) for i in range(36)])


def test_jaccard_of_odd_texts(spark, odd, empty):
    compare(spark, odd_rows())
    assert jaccard.similar_documents(empty).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # 5 to 8, the repeated rows and one with a null id are one group; 10 and 11 are near.
    assert Counter(ids) == Counter([0, 1, 2, 3, 4, 5, 9, 10, 12, None])


def test_rows_of_one_id_are_told_apart(spark):
    """Different texts of one id, copies without an id, and columns with names used inside."""
    other = "a wholly different text of some ten words that nobody else has"
    rows = [(7, PROSE), (7, other), (7, other), (None, PROSE + " again"), (None, "only copies have no id in this group"), (None, "only copies have no id in this group")]
    rows += [(3, PROSE), (None, None), (None, None), (4, "")]
    names = ["part", "_size", "_key", "_copy", "text_key", "record", "key"]
    data = [(*r, "s", *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame(data, schema).repartition(3)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    found = [tuple(r) for r in kept.collect()]
    assert set(found) <= set(data)
    want = [(7, other), (None, "only copies have no id in this group"), (3, PROSE), (None, None), (None, None), (4, "")]
    assert Counter(r[:2] for r in found) == Counter(want)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert {tuple(r) for r in mixed.collect()} <= set(data) and mixed.count() > 0


def test_components(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + draw.randint(0, 30), 100 + draw.randint(0, 30)) for _ in range(25)] + [(-5, 9)]
    edges = [e for e in edges if e[0] != e[1]]
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    found = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.comp for r in found.collect()} == comp
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- sharding -----------------------------------------------------------------------------


def test_shards(spark, odd, empty):
    df = spark.range(1001).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"))
    rows = sharding.shard_records(df, bucket_bytes=4096).select("record.doc_id", "shard", "slot").collect()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert sorted(by_shard) == list(range(8)) and {len(s) for s in by_shard.values()} <= {125, 126}
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sorted(r.doc_id for r in rows) == list(range(1001))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(1001))[0, 1]) < 0.2
    placed = sharding.shard_records(odd)
    assert placed.count() == odd.count() and placed.select("record.*").columns == odd.columns
    assert sharding.shard_records(empty).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_records_are_kept_whole(spark, monkeypatch, broadcast):
    """Columns that cannot be compared and names used inside; offsets by broadcast or by a join give the same."""
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", broadcast)
    rows = [(i, f"té{i}" * (i % 7) if i % 5 else None, {f"k{i}": i}, i, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket map<string,int>, mark long, record string").repartition(4)
    placed = sharding.shard_records(df, bucket_bytes=256, shards=7)
    found = [(tuple(r.record), r.shard, r.slot) for r in placed.collect()]
    assert sorted((x for x, _, _ in found), key=lambda x: x[0]) == rows
    assert sorted((s, k) for _, s, k in found) == [(s, k) for s in range(7) for k in range((300 * (s + 1) + 6) // 7 - (300 * s + 6) // 7)]


def test_shard_query_columns(spark, tmp_path):
    rows = [(1, "añb", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.QUERIES["op2_external_shuffle"].run(spark, str(tmp_path)).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def test_written_shards(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sharding.write_shards(df, str(tmp_path / "shards"), shards=4)
    read = spark.read.parquet(str(tmp_path / "shards"))
    assert {r["count"] for r in read.groupBy("_shard").count().collect()} == {25}


# --- mixing ---------------------------------------------------------------------------------


def plain_targets(sizes):
    """Excess is shared again until no target is above three times its source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3 * sizes[s] for s in capped}
        capped |= over


def test_mix(spark):
    draw = random.Random(7)
    rows = []
    for s, n in (("a", 4), ("b", 40), ("c", 3), ("d", 200), ("B", 30), (None, 60), ("é", 10)):
        rows += [(len(rows) + k, "w " * draw.randint(0, 90), "en", s, 1) for k in range(n)]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(4)
    found = {r.doc_id: r for r in mixing.mix(mixing.measured(df)).collect()}
    assert len(found) == len(rows)
    sizes, taken = Counter(), Counter()
    for doc_id, text, _, source, _ in rows:
        assert found[doc_id].size == len(text.split()) and 0 <= found[doc_id].taken <= 3 * found[doc_id].size
        sizes[source] += found[doc_id].size
        taken[source] += found[doc_id].taken
    goal = plain_targets(sizes)
    for doc_id, _, _, source, _ in rows:
        assert found[doc_id].source_size == sizes[source] and abs(found[doc_id].target - goal[source]) < 1e-6
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix(mixing.measured(df.repartition(2))).collect()}
    assert again == {i: r.taken for i, r in found.items()}


def test_mixed_documents(spark, odd, empty):
    rows = [(i, "word " * (1 + i % 7), "en", "ab"[i % 2], 1) for i in range(200)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        assert r.text == rows[r.doc_id][1]
        words[r.source] += len(r.text.split())
    total = sum(len(r[1].split()) for r in rows)
    assert abs(words["a"] - total * 5 / 7) <= 7 and abs(words["b"] - total * 2 / 7) <= 7
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.mix(mixing.measured(odd)).count() == odd.count()


# --- neighbours -----------------------------------------------------------------------------


def test_neighbours(spark):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((1500, 16)).astype(np.float32)
    vectors[100:110] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0] * 15), (5200, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in neighbors.nearest_neighbours(df, is_query=F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    exact = vectors.astype(float)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        like = unit @ unit[q]
        like[q] = -2
        best = sorted(range(1500), key=lambda i: (-round(like[i], 12), i))[:5]
        hits += len(set(best) & {v for v, _ in found[q]})
        assert all(abs(score - like[v]) < 1e-12 for v, score in found[q])
    assert hits >= 0.9 * 150
    assert [v for v, _ in found[100]] == [50, 101, 102, 103, 104]
    assert set(found) == set(range(0, 1500, 50))


def test_neighbours_over_many_blocks(spark, monkeypatch):
    """Few first neighbours, so that what iterations find is what counts."""
    monkeypatch.setattr(neighbors, "BLOCK", 8)
    for n in (1000, 4000):
        vectors = np.random.default_rng(n).standard_normal((n, 48)).astype(np.float32)
        df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>").repartition(4)
        found = defaultdict(set)
        for r in neighbors.nearest_neighbours(df, is_query=F.col("vec_id") % 20 == 0).collect():
            found[r.query_id].add(r.vec_id)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        like = unit[::20] @ unit.T
        like[np.arange(n // 20), np.arange(0, n, 20)] = -2
        best = np.argsort(-like, axis=1)[:, :5]
        assert sum(len(found[20 * i] & set(row.tolist())) for i, row in enumerate(best)) >= 0.9 * best.size
    # The graph itself holds nearly all of the nearest, long before a query searches it.
    nodes = neighbors.nodes_of(neighbors.usable(df))
    ids = {r.node: r.vec_id for r in neighbors.usable(df).select("node", "vec_id").collect()}
    edges = {(ids[r.node], ids[x.v]) for r in neighbors.graph(nodes, n).collect() for x in r.neighbours}
    assert sum((20 * i, int(v)) in edges for i, row in enumerate(best) for v in row) >= 0.9 * best.size
    assert neighbors.sizes(1000) == (32, 120) and neighbors.sizes(80_000) == (40, 240) and neighbors.sizes(2_000_000) == (59, 1200)


def test_only_nodes_with_something_new_around_them_ask_for_vectors(spark):
    entry = lambda far, v, new: (far, v, new)
    rows = [(1, b"", [entry(-0.9, 2, False), entry(-0.8, 3, False)]), (2, b"", [entry(-0.9, 1, False)]), (3, b"", [entry(-0.8, 1, False)]), (4, b"", [entry(-0.7, 5, True)]), (5, b"", [])]
    edges = spark.createDataFrame(rows, "node bigint, unit binary, neighbours array<struct<far: float, v: bigint, new: boolean>>")
    assert {tuple(r) for r in neighbors.asked(edges, 8).collect()} == {(4, 5, True), (5, 4, True)}
    assert neighbors.orders(10_256) == 8 and neighbors.orders(51_282) == 14


def test_vectors_of_several_lengths(spark):
    """Each length is searched by itself, also one that is rare; without others of its length a query has no rows."""
    draw = np.random.default_rng(8)
    rows = [(i, draw.standard_normal(8 if i % 4 else 5).tolist()) for i in range(600)] + [(1000, [1.0, 2.0, 3.0]), (1050, [1.0]), (1051, [-2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = defaultdict(list)
    for r in neighbors.nearest_neighbours(df, is_query=F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    hits = 0
    for q in range(0, 600, 50):
        others = [i for i in unit if i != q and len(unit[i]) == len(unit[q])]
        best = sorted(others, key=lambda i: -float(unit[i] @ unit[q]))[:5]
        assert set(found[q]) <= set(others)
        hits += len(set(best) & set(found[q]))
    assert hits >= 0.95 * 60
    assert found[1050] == [1051] and 1000 not in found


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], schema)
    rows = neighbors.nearest_neighbours(few, is_query=F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in rows] == [(1, 2), (2, 1)]
    for rows in ([], [(0, [1.0])], [(0, None)]):
        df = spark.createDataFrame(rows, schema)
        assert neighbors.nearest_neighbours(df, is_query=F.col("vec_id") % 50 == 0).count() == 0


def test_later_orders_give_only_what_is_nearer(spark, monkeypatch):
    """The start of a larger graph is what all orders at once give, from far fewer neighbours than one list a node and order."""
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    monkeypatch.setattr(neighbors, "FEW", 150)
    vectors = np.random.default_rng(9).standard_normal((1200, 16)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>").repartition(3)
    nodes = neighbors.nodes_of(neighbors.usable(df)).localCheckpoint()
    turns, most = neighbors.orders(1200), 10
    assert turns == 20
    # One part, so that blocks are cut at the same rows however many orders come at once.
    first = neighbors.first_neighbours
    monkeypatch.setattr(neighbors, "first_neighbours", lambda nodes, count, most, turns: first(nodes, 1, most, turns))
    given = lambda orders, least: neighbors.first_neighbours(nodes.withColumn("least", least), 1200, most, orders)
    listed = defaultdict(dict)
    for r in given(range(turns), F.lit(-2.0).cast("float")).collect():
        listed[r.node].update({x.v: x.far for x in r.neighbours if x.v != r.node})
    start = {r.node: [(x.v, x.far) for x in r.neighbours] for r in neighbors.first_graph(nodes, 1200, most).collect()}
    assert len(start) == 1200 and all(len({v for v, _ in x}) == most for x in start.values())
    for node, has in start.items():
        assert np.allclose([far for _, far in has], sorted(listed[node].values())[:most], atol=1e-5)
    bound = F.lit(float(-np.median([has[-1][1] for has in start.values()]))).cast("float")
    entries = lambda rows: rows.select(F.sum(F.size("neighbours"))).first()[0]
    assert entries(given(range(4, turns), bound)) < 0.3 * entries(given(range(4, turns), F.lit(-2.0).cast("float")))


def test_neighbours_are_merged_as_by_full_sorts():
    draw = np.random.default_rng(2)
    row = np.sort(draw.integers(0, 40, 6000))
    v = draw.integers(-(2**62), 2**62, 90)[draw.integers(0, 90, 6000)]
    far, new = (draw.integers(-9, 9, 6000) / 9).astype(np.float32), draw.random(6000) < 0.5
    order, whole = neighbors._by_distance(row, far, v), np.lexsort((v, far, row))
    assert all(np.array_equal(x[order], x[whole]) for x in (row, far, v))
    for low in (v, v << 44):  # the second: other nodes whose low bits are the same
        order, whole = neighbors._by_node(row, low, new, far), np.lexsort((far, new, low, row))
        firsts = []
        for o in (order, whole):
            once = np.append(True, (row[o][1:] != row[o][:-1]) | (low[o][1:] != low[o][:-1]))
            firsts.append(sorted(zip(row[o][once].tolist(), low[o][once].tolist(), new[o][once].tolist())))
        assert firsts[0] == firsts[1]


def test_search_broadcasts_nothing_of_unknown_size(spark, monkeypatch):
    """Rows after an explode are many more than Spark takes them for: with no visits few enough, all joins go by shuffles."""
    plans = []
    materialize = neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df))
    monkeypatch.setattr(neighbors, "SENT", 0, raising=False)
    monkeypatch.setattr(neighbors, "HELD", 64, raising=False)
    vectors = np.random.default_rng(4).standard_normal((500, 24)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>")
    result = neighbors.nearest_neighbours(df, is_query=F.col("vec_id") % 50 == 0)
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not any("Broadcast" in plan for plan in plans)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in result.collect():
        found[r.query_id].add(r.vec_id)
    best = {q: set(np.argsort(-(unit @ unit[q]))[1:6].tolist()) for q in range(0, 500, 50)}
    assert sum(len(best[q] & found[q]) for q in best) >= 48


def test_only_what_may_be_nearest_is_scored_again(spark):
    """Few of the kept nodes are, yet enough where an id stands beside several vectors that are all nearer than any other id's."""
    draw = np.random.default_rng(6)
    vectors = draw.standard_normal((400, 24))
    near = vectors[0] + 0.01 * draw.standard_normal((9, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(0, v.tolist()) for v in near]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in neighbors.nearest_neighbours(df, is_query=F.col("vec_id") % 200 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert len(found[0]) == 50 and 0 not in {v for v, _ in found[0]}
    assert {v for v, _ in found[0]} >= set((1 + np.argsort(-(unit[1:] @ unit[0]))[:5]).tolist())
    like = unit @ unit[200]
    like[200] = -2
    others = [(int(i), like[i]) for i in np.argsort(-like) if i][:5]
    assert [v for v, _ in found[200] if v] == [v for v, _ in others][: sum(v > 0 for v, _ in found[200])]
    nodes = neighbors.nodes_of(neighbors.usable(df))
    queries = nodes.limit(5).select(F.col("node").alias("query"), F.lit(6).alias("wanted"))
    assert neighbors.search(queries, neighbors.graph(nodes, 409), 409).count() < 5 * 40


# --- the pipeline ---------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = odd_rows() + near_copies(2, 20)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    rows.append((len(rows), PROSE.replace("quick", "slow") + " password = 'hunter22'", "en", "s1", 9))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r.doc_id: r.text for r in docs.collect()}
    comp = {i: c for i, n, c in plain_components(rows) if n}
    assert all(comp[i] == i for i in left)
    assert all(left[i] == texts[i] for i in left if "password" not in texts[i])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(left)


def test_pipeline_stages_send_small_batches(spark, tmp_path, monkeypatch):
    """Rows of 50 KB, written after a stage has returned, would reach Python in one batch of 10 MB; run sets the session back."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from subsumo.llm import common, mixing, toxicity

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    documents = spark.range(0, 200, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 5000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars")
    )
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))

    @F.pandas_udf("bigint")
    def rows_of_batch(texts):
        return texts.map(lambda _: len(texts))

    measured = lambda docs: docs.withColumn("n_chars", rows_of_batch("text"))
    monkeypatch.setattr(toxicity, "without_toxic", lambda docs, weights: measured(docs))
    monkeypatch.setattr(corpus_pipeline.jaccard, "one_of_each", measured)
    monkeypatch.setattr(corpus_pipeline.secrets, "redact_secrets", lambda docs, **_: measured(docs))
    monkeypatch.setattr(mixing, "mixed_documents", measured)
    monkeypatch.setattr(corpus_pipeline.bpe, "encode_documents", lambda docs, outputs: measured(docs))
    try:
        for step, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, before)
            out = stage(spark, documents, str(tmp_path))
            assert out.agg(F.max("n_chars")).first()[0] * 55_000 <= 2 * common.BATCH_BYTES, step
        spark.conf.set(name, before)
        corpus_pipeline.run(spark, str(tmp_path))
        assert spark.conf.get(name) == before
    finally:
        spark.conf.set(name, before)
