import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm.neighbours import Graph, _unit, nearest_neighbours, shards_for

KINDS = "vec_id long, embedding array<float>"


def exact(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    units = _unit(np.array([np.array(v, np.float32) for _, v in rows], float))
    out = {}
    for q in queries:
        scores = units @ units[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), scores[i]) for i in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(6000)]
    frame = spark.createDataFrame(rows, KINDS)
    out = nearest_neighbours(frame, F.col("vec_id") % 50 == 0, k=5).collect()
    want = exact(rows, range(0, 6000, 50), 5)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert all(len(v) == 5 for v in got.values()) and set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    truth = dict(rows)
    for q, found in got.items():
        scores = [s for _, s in found]
        assert scores == sorted(scores, reverse=True)
        for i, s in found:
            a, b = np.array(truth[q], float), np.array(truth[i], float)
            assert abs(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) - s) < 1e-12


def test_ties_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(200)]
    rows += [(1000, [2.0, 4.0]), (1001, [-1.0, 0.0]), (1050, [0.0, 0.0]), (1100, None), (1150, [nan, 1.0]), (1200, [inf, 1.0]), (1250, [None, 1.0]), (1300, []), (1350, [1.0, 0.0, 0.0]), (50, [1.0, 2.0])]
    out = nearest_neighbours(spark.createDataFrame(rows + [(None, [1.0, 2.0])], KINDS), F.col("vec_id") % 50 == 0, k=5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 150: [0, 1, 2, 3, 4], 1000: [0, 1, 2, 3, 4]}


def test_fewer_than_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    out = nearest_neighbours(spark.createDataFrame(rows, KINDS), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in out] == [(1, 0.0)]
    assert nearest_neighbours(spark.createDataFrame([], KINDS), F.lit(True)).count() == 0


def test_graph_is_reachable():
    unit = _unit(np.random.default_rng(2).normal(size=(500, 8))).astype(np.float32)
    graph = Graph.build(unit, width=40)
    found = sum(graph.nearest(unit[i], 20)[0] == i for i in range(500))
    assert found >= 490 and graph.links[0].shape == (500, 32) and Graph.build(unit[:0]).nearest(unit[0], 5) == []


def test_recall_on_the_table_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr("tallyspark.llm.neighbours.SHARD_ROWS", 400)
    monkeypatch.setattr("tallyspark.llm.neighbours.SHARD_ROOT", 0)
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert shards_for(len(rows)) >= 3
    asked = [i for i, _ in rows if i % 50 == 0]
    want = exact(rows, asked, 5)
    got = {}
    for r in nearest_neighbours(frame, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_shards_grow_with_the_rows():
    assert [shards_for(n) for n in (0, 1, 4096, 4097, 50_000)] == [1, 1, 1, 2, 13]
    assert shards_for(1_000_000) == 63 and shards_for(10**9) == 15_259
