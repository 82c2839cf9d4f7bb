"""Problems 5 and 6: nearest vectors and similar sets, against brute force."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, set_join, vector_graph


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vector_graph.build_graph(np.arange(6000) * 3, x)
    near, _ = vector_graph._nearest(g.x, 5)
    found, sim = g.search(g.x, 64)
    assert (np.diff(sim, axis=1) <= 0).all()
    hits = sum(len(set(f[:6]) & set(n)) for f, n in zip(found, near))
    assert hits >= 0.9 * near.size


def test_a_hub_keeps_its_nearest():
    # 300 vectors at once get an edge back from one node; the nearest of them are among its candidates.
    rng = np.random.default_rng(3)
    x = np.concatenate([[np.eye(8)[0]], np.eye(8)[0] + rng.normal(size=(300, 8)) * np.linspace(1, 0.01, 300)[:, None]]).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = np.full((301, 4), -1, np.int32)
    edges[1:, 0] = 0
    vector_graph._add_back(x, edges, np.arange(1, 301), 4, 1.15)
    assert (x[1:] @ x[0]).argmax() + 1 in edges[0]


def test_queries_start_from_their_own_place():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vector_graph.build_graph(np.arange(3000) * 7, x)
    found, sim = g.search(x, 30, keys=np.arange(3000) * 7)
    assert (g.ids[found[:, 0]] == np.arange(3000) * 7).all()
    other, _ = g.search(x[:50], 30, keys=np.arange(50) * 7 + 1)
    assert (other >= 0).all()


def test_tiny_graphs():
    for n in (0, 1, 2, 5):
        x = np.eye(5, dtype="f4")[:n]
        g = vector_graph._unpack(vector_graph._pack(vector_graph.build_graph(np.arange(n), x.reshape(n, 5))))
        found, _ = g.search(np.eye(5, dtype="f4"), 8)
        assert all(sorted(i for i in row if i >= 0) == list(range(n)) for row in found)


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, (np.array(rows[i][1]) + rng.normal(size=8) * 0.05).tolist()) for i in range(40)]
    rows += [(2000 + i, (np.array(rows[7][1]) * (i + 1)).tolist()) for i in range(9)]  # copies of another length
    whole = {i: np.array(v, "f4") for i, v in rows}
    rows += rows[:30] + [(3000, None), (3001, [0.0] * 8), (3002, [1.0] * 5), (3003, [float("nan")] * 8), (3004, [None] * 8), (None, [1.0] * 8)]
    return whole, spark.createDataFrame([(i, v, "k", 1) for i, v in rows], "id bigint, vec array<float>, rep string, similarity int").repartition(4)


def test_nearest(spark):
    whole, df = vectors(spark)
    ids = np.array(sorted(whole))
    x = np.stack([whole[i] for i in ids]).astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 4)
    for shard, probes in ((100_000, None), (120, None)):
        got = {}
        for r in vector_graph.nearest(df, "id", "vec", k=5, dim=8, probes=probes, shard=shard).collect():
            got.setdefault(r["key"], []).append((round(r["similarity"], 4), r["other"]))
        assert set(got) == set(whole) and all(len(v) == 5 for v in got.values())
        hits = 0
        for row, i in enumerate(ids):
            best = sorted((-s, j) for s, j in zip(sims[row], ids) if j != i)[:5]
            hits += sum(abs(a[0] + b[0]) < 2e-4 for a, b in zip(sorted(got[i], reverse=True), best))
        assert hits >= 0.97 * 5 * len(ids)
    some = vector_graph.nearest(df, "id", "vec", k=5, dim=8, only=lambda k: k % 50 == 0).select("key").distinct().collect()
    assert {r["key"] for r in some} == {i for i in whole if i % 50 == 0}
    assert vector_graph.nearest(df.limit(0), "id", "vec", dim=8).collect() == []
    assert vector_graph.nearest(df.filter("id = 3000"), "id", "vec", dim=8).collect() == []
    assert vector_graph.nearest(df.filter("id = 5"), "id", "vec", dim=8).collect() == []


def test_pairs_across_many_shards(spark, tmp_path, monkeypatch):
    # Pairs just above 0.9 of noise in 64 dimensions, in about 20 shards.
    rng = np.random.default_rng(6)
    x, noise = rng.normal(size=(2, 2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.902 * x + np.sqrt(1 - 0.902**2) * noise
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    spark.createDataFrame(rows, "file_id bigint, vec array<float>").repartition(4).write.parquet(f"{tmp_path}/file_vector.parquet")
    monkeypatch.setattr(vector_graph, "nearest", partial(vector_graph.nearest, shard=200))
    got = {(r["file_id_a"], r["file_id_b"]) for r in queries.p5_found(spark, str(tmp_path)).collect()}
    assert got == {(i, i + 2000) for i in range(2000)}


def test_skipped_shards_hold_nothing_near():
    # Clusters, so that shards are skipped at all.
    rng = np.random.default_rng(7)
    c = rng.normal(size=(12, 8))
    x = np.repeat(c, 150, axis=0) + rng.normal(size=(1800, 8)) * 0.3
    c, x = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (c, x))
    own = (x @ c.T).argmax(axis=1)
    batch = vector_graph.pa.RecordBatch.from_arrays([vector_graph.pa.array(range(1800)), vector_graph.pa.array(list(x))], ["rep", "v"])
    routed = next(vector_graph._route(c, 12, 0.9)([batch]))
    asked = set(zip(routed["rep"].to_pylist(), routed["centroid"].to_pylist()))
    assert 1800 < len(asked) < 0.8 * 12 * 1800
    a, b = np.nonzero(x @ x.T >= 0.9)
    assert all(p in asked for p in zip(a.tolist(), own[b].tolist()))


def test_routes_to_many_centroids_come_in_small_batches():
    # As many centroids as 6 GB of vectors have; a worker must not hold a batch once per centroid.
    rng = np.random.default_rng(8)
    c, x = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (rng.normal(size=(300, 64)).astype("f4"), rng.normal(size=(1000, 64)).astype("f4")))
    batch = vector_graph.pa.RecordBatch.from_arrays([vector_graph.pa.array(range(1000)), vector_graph.pa.array(list(x))], ["rep", "v"])
    sizes = [b.num_rows for b in vector_graph._route(c, 300)([batch])]
    assert sum(sizes) == 300_000 and max(sizes) <= 40_000


def test_rounds_find_what_one_round_finds(spark, monkeypatch):
    _, df = vectors(spark)
    ask = partial(vector_graph.nearest, df, "id", "vec", k=5, dim=8, shard=60)
    rows = sorted(map(tuple, ask().collect()))
    monkeypatch.setattr(vector_graph, "ROUND", 20_000)
    monkeypatch.setattr(vector_graph, "PIECE", 999)
    monkeypatch.setattr(vector_graph, "ROUNDS", 1)
    assert sorted(map(tuple, ask().collect())) == rows
    close = sorted(map(tuple, ask(least=0.8).collect()))
    assert close == [r for r in rows if r[2] >= 0.8] and len(close) < len(rows)


def sets(spark, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(700):
        s = ["hot", "hot2", *rng.sample(vocabulary, rng.randint(3, 40))]
        rows.append((i, s))
        for c in range(rng.choice([0, 0, 0, 1, 2])):
            rows.append((1000 + 3 * i + c, s[rng.randint(0, 3) :] + rng.sample(vocabulary, rng.randint(0, 3))))
    rows += [(9000 + i, [f"c{j}" for j in range(12)]) for i in range(150)]  # one class of copies
    rows += [(9500, [f"c{j}" for j in range(11)]), (9600, None), (9601, []), (9602, ["a", None, "b"]), (9603, ["a"] * 9), (None, [f"c{j}" for j in range(12)])]
    rows += rows[:20]
    return rows, spark.createDataFrame([(*r, "k", "n") for r in rows], "id bigint, items array<string>, key string, node string").repartition(3)


def brute(rows, threshold, least):
    s = {i: frozenset(x for x in v if x is not None) for i, v in rows if i is not None and v}
    s = {i: v for i, v in s.items() if len(v) >= least}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}, s


def test_set_join(spark):
    rows, df = sets(spark)
    truth, s = brute(rows, 0.7, 5)
    classes, members = set_join.set_classes(df, "id", F.col("items"), 5)
    pairs = set_join.similar_classes(classes, 0.7)
    got = {(r["key_a"], r["key_b"]) for r in set_join.member_pairs(pairs, members).collect()}
    assert got <= truth and len(got) >= 0.99 * len(truth)
    rep = {r["key"]: r["rep"] for r in members.collect()}
    assert rep == {i: min(j for j in s if s[j] == s[i]) for i in s}


@pytest.mark.parametrize("levels", [2, 64])
def test_large_nodes_are_compared_in_blocks(spark, levels):
    # Every set shares most of its items with every other: no node ever gets small.
    common = [f"c{i}" for i in range(30)]
    rows = [(i, common + [f"u{i}a", f"u{i}b"]) for i in range(260)]
    df = spark.createDataFrame(rows, "id bigint, items array<string>")
    classes, _ = set_join.set_classes(df, "id", F.col("items"), 5)
    pairs = 260 * 259 // 2
    assert 0.99 * pairs <= set_join.similar_classes(classes, 0.7, levels=levels, block=64).count() <= pairs


def test_many_sets_in_one_node_and_many_copies(spark):
    # 20,000 sets that share a third of their items, and 30,000 copies of one set beside them.
    spread = spark.range(20_000).selectExpr("id", "concat(array('h1', 'h2', 'h3', 'h4'), transform(sequence(1, 8), i -> concat('w', pmod(xxhash64(id, i), 4000)))) as items")
    near = spark.range(0, 20_000, 40).selectExpr("id + 100000 as id", "concat(array('h1', 'h2', 'h3', 'h4', 'new'), transform(sequence(1, 8), i -> concat('w', pmod(xxhash64(id, i), 4000)))) as items")
    copies = spark.range(30_000).selectExpr("id + 200000 as id", "transform(sequence(1, 9), i -> concat('c', i)) as items")
    df = spread.union(near).union(copies)
    classes, members = set_join.set_classes(df, "id", F.col("items"), 5)
    pairs = set_join.similar_classes(classes, 0.7)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    want = {(i, i + 100_000) for i in range(0, 20_000, 40)}
    assert len(got & want) >= 0.995 * len(want)
    assert members.filter("rep = 200000").count() == 30_000 and not any(a >= 200_000 or b >= 200_000 for a, b in got)


def test_members_of_large_classes_are_spread(spark):
    rows = [(i, 0) for i in range(2000)] + [(5000 + i, 5000) for i in range(700)] + [(9000, 9000), (9001, 9000)]
    members = spark.createDataFrame(rows, "key bigint, rep bigint").repartition(4)
    pairs = spark.createDataFrame([(0, 5000, 0.8), (0, 9000, 0.7), (5000, 9000, 0.75)], "a bigint, b bigint, similarity double")
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}  # joins by shuffle, as those of large tables
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        out = set_join.member_pairs(pairs, members)
        total = 2702 * 2701 // 2
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == out.select("key_a", "key_b").distinct().count() == total and out.filter("key_a >= key_b").isEmpty()
        assert max(tasks) < 0.5 * total, tasks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by = {r["similarity"]: r["count"] for r in out.groupBy("similarity").count().collect()}
    assert by == {0.8: 2000 * 700, 0.7: 2000 * 2, 0.75: 700 * 2, 1.0: total - 2000 * 702 - 700 * 2}


def test_sets_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ["a"])], "id bigint, items array<string>")
    classes, members = set_join.set_classes(df, "id", F.col("items"), 5)
    assert set_join.member_pairs(set_join.similar_classes(classes, 0.7), members).collect() == []
