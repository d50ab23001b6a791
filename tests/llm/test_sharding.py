import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm.sharding import Ring, place, ring_shards, with_parts


def test_walks_meet_every_shard_clockwise():
    ring = Ring(4, points=3)
    for i, walk in enumerate(ring.walks):
        owners = []
        for j in range(len(ring.walks)):
            owner = ring.walks[(i + j) % len(ring.walks)][0]
            if owner not in owners:
                owners.append(owner)
        assert list(walk) == owners
    assert ring.walk(ring.places[5]) == ring.walks[5] and ring.walk(ring.places[-1] + 1) == ring.walks[0]


def test_full_shards_are_passed_over():
    ring = Ring(3)
    free = np.array([10, 10, 10])
    homes = place([(0, 10), (0, 10), (0, 10), (0, 1)], ring, free)
    assert homes[:3] == list(ring.walk(0)) and free.sum() == -1


def _texts(seed, n):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefg é"), rng.integers(3, 9))) for _ in range(300)]
    out = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(n)]
    return out + [out[0]] * (n // 20) + [None, None, "", ""]


def test_balanced_gapless_and_whole_groups(spark):
    texts = _texts(1, 3000)
    rows = list(enumerate(texts))
    out = ring_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=4).toPandas()
    assert sorted(out.doc_id) == [i for i, _ in rows]
    size = out.text.map(lambda t: len((t or "").encode()) + 1)
    loads = size.groupby(out["shard"]).sum()
    assert loads.max() / loads.mean() < 1.01 and loads.min() / loads.mean() > 0.98
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    crc = out.text.map(lambda t: zlib.crc32((t or "").encode()))
    assert out.groupby(crc)["shard"].nunique().max() == 1


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "x" * 50) for i in range(900)] + [(1000 + i, f"text {i}" * 3) for i in range(300)]
    out = ring_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).toPandas()
    size = out.text.map(len) + 1
    loads = size.groupby(out["shard"]).sum()
    assert len(loads) == 8 and loads.max() / loads.mean() < 1.1


def test_few_groups_move_when_a_shard_is_added(spark):
    docs = spark.createDataFrame(list(enumerate(_texts(2, 3000)[:3000])), "doc_id long, text string")
    a = ring_shards(docs, shards=8).toPandas().set_index("doc_id")["shard"].sort_index()
    b = ring_shards(docs, shards=9).toPandas().set_index("doc_id")["shard"].sort_index()
    assert (a != b).mean() < 0.5


def test_edges(spark):
    kinds = "doc_id long, text string, shard string, _key int"
    assert ring_shards(spark.createDataFrame([], kinds)).count() == 0
    rows = [(None, None, "a", 1), (1, "t", "b", 2), (1, "t", "b", 2), (2, "x" * 100_000, None, None)]
    out = ring_shards(spark.createDataFrame(rows, kinds), shards=2)
    assert out.columns[:4] == ["doc_id", "text", "shard", "_key"] and {"shard_", "slot"} <= set(out.columns)
    assert out.count() == 4


def test_a_group_larger_than_a_shard_without_ids(spark):
    """Its rows are dealt by a hash of the whole row, with null ids and with none."""
    rows = [(None, "the same text again and again", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for docs in (df, df.drop("doc_id")):
        out = ring_shards(docs, shards=8).toPandas()
        held = out.groupby("shard").size()
        assert len(held) == 8 and held.max() < 1.4 * held.min()
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_extra_columns_named_like_internal_ones(spark):
    names = ["_home", "_p", "_k", "_range", "_row", "_start", "_n", "_group", "_of", "_key", "_weight"]
    df = spark.createDataFrame([(i, f"t{i}", *range(len(names))) for i in range(9)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = ring_shards(df, shards=2)
    assert out.columns == [*df.columns, "shard", "slot"] and all(tuple(r)[2:-2] == tuple(range(len(names))) for r in out.collect())


def test_many_equal_rows_beside_others(spark):
    """Rows that nothing tells apart are dealt evenly, too, keep their number, and slots stay gapless."""
    kinds = "doc_id long, text string, x double, tags array<string>"
    same = (7, "copied through and through " * 4, -0.0, ["a", None])
    rows = [same] * 6000 + [(i, f"text {i}", float(i), None) for i in range(500)]
    out = ring_shards(spark.createDataFrame(rows, kinds), shards=8).toPandas()
    out["size"] = out["text"].str.len() + 1
    held = out.groupby("shard")["size"].sum()
    assert len(held) == 8 and held.max() < 1.1 * held.min()
    assert (out["doc_id"] == 7).sum() == 6001 and len(out) == 6500 and (np.signbit(out["x"])).sum() == 6000
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_equal_rows_reach_all_parts(spark):
    same = spark.range(0, 5000).selectExpr("1L as doc_id", "'t' as text", "2 as _hash")
    held = with_parts(same, "p").groupBy("p").count().toPandas()
    assert held["count"].sum() == 5000 and len(held) == 256 and held["count"].max() < 60
    variant = same.withColumn("v", F.parse_json(F.lit("{}")))
    assert with_parts(variant, "p").count() == 5000
