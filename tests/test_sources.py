import json
import os
import struct

import pytest

from pyspark.sql import functions as F

from tallyspark.sources import bundles as B
from tallyspark.sources import files as S
from tallyspark.sources import ranges as R
from tallyspark.streaming.events import last_state_stream, tumbling_stream, unseen


def test_paths_stay_in_their_root(tmp_path):
    (tmp_path / "a").mkdir()
    os.symlink("/etc", tmp_path / "out")
    assert S.contained(str(tmp_path), "a/b.json") == str(tmp_path / "a/b.json")
    for bad in ("/etc/passwd", "../x", "a/../../x", "out/passwd"):
        with pytest.raises(ValueError):
            S.contained(str(tmp_path), bad)


def test_json_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    bad.write_text('{"a": 1}\nnot json\n{"a": 3}\n' + "[" * 80 + "]" * 80 + "\n")
    assert sorted(r.a for r in S.read_jsonl(spark, str(good), "a INT").collect()) == [1, 2]
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(bad), "a INT").collect()
    assert sorted(r.a for r in S.read_jsonl_tolerant(spark, str(bad), "a INT").collect()) == [1, 3]


def test_csv_is_text_and_folders_are_ordered(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n01,x\n")
    assert S.read_csv_text(spark, str(tmp_path / "t.csv")).collect()[0].a == "01"
    (tmp_path / "docs").mkdir()
    for n in ("b", "a"):
        (tmp_path / "docs" / f"{n}.json").write_text(json.dumps({"n": n}))
    out = S.read_ordered_json(spark, str(tmp_path / "docs"), "n STRING").orderBy("file_name").collect()
    assert [(r.n, r.file_name) for r in out] == [("a", "a.json"), ("b", "b.json")]


def test_binary(spark, tmp_path):
    (tmp_path / "g").write_bytes(struct.pack("<6b", 1, -1, 127, -128, 0, 5))
    grid = R.read_grid(spark, str(tmp_path / "g"), 2, 3).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.value) for r in grid] == [(0, 0, 1), (0, 1, -1), (0, 2, 127), (1, 0, -128), (1, 1, 0), (1, 2, 5)]
    with pytest.raises(Exception, match="another size"):
        R.read_grid(spark, str(tmp_path / "g"), 2, 2).collect()
    (tmp_path / "p").write_bytes(struct.pack("<3h", 300, -300, -32768))
    assert [r.v for r in R.read_pcm(spark, str(tmp_path / "p")).orderBy("i").collect()] == [300, -300, -32768]
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="odd"):
        R.read_pcm(spark, str(tmp_path / "odd")).collect()
    (tmp_path / "w").write_text(" b \n\na\na\n")
    assert sorted(r.word for r in S.read_words(spark, str(tmp_path / "w")).collect()) == ["a", "b"]


def test_sinks_and_walks(spark, tmp_path):
    log = str(tmp_path / "log")
    S.append_unique(spark.createDataFrame([("t1", None)], "id string, v int"), log, "id")
    S.append_unique(spark.createDataFrame([("t2", 5)], "id string, v int"), log, "id")
    with pytest.raises(ValueError):
        S.append_unique(spark.createDataFrame([("t1", 6)], "id string, v int"), log, "id")
    rows = spark.read.json(log)
    assert rows.count() == 2 and S.lookup_one(rows, "id", "t2").collect()[0].v == 5
    for missing in ("t3",):
        with pytest.raises(LookupError):
            S.lookup_one(rows, "id", missing)
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "x").write_text("hello")
    os.symlink("x", root / "sub" / "y")
    listed = S.files_under(spark, str(root)).collect()
    assert [r.path for r in listed if r.path == "sub/x"] and {r.path: r.kind for r in B.listing(spark, str(root)).collect()} == {"sub": "folder", "sub/x": "file", "sub/y": "link"}
    files = spark.createDataFrame([("sub/x",)], "path string")
    copy = B.sealed_copy(files, str(root), str(tmp_path / "seal")).collect()[0]
    assert copy.sha256 == next(r.sha256 for r in listed if r.path == "sub/x") and (tmp_path / "seal/sub/x").read_text() == "hello"
    with pytest.raises(ValueError):
        B.sealed_copy(spark.createDataFrame([("sub/y",)], "path string"), str(root), str(tmp_path / "seal2"))
    written = S.write_dataset(spark.createDataFrame([(1,)], "a int"), str(tmp_path), "set")
    assert written.count() == 1


def _run(spark, frame, mode, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "cast(value * 100 as bigint) as c")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    from tallyspark.operators.windows import tumbling

    want = {tuple(r) for r in tumbling(events, "ts", "1 hour", "c").collect()}
    got = {tuple(r) for r in _run(spark, tumbling_stream(stream(), "ts", "1 hour", "c", "10 minutes"), "complete", "w").collect()}
    assert got == want
    last = {r.user_id: r.last_ts for r in _run(spark, last_state_stream(stream(), "user_id", "ts", "c"), "complete", "s").collect()}
    assert last == {r[0]: r[1] for r in events.groupBy("user_id").agg({"ts": "max"}).collect()}
    twice = stream().union(stream())
    assert _run(spark, unseen(twice, "event_id", "ts", "40 days"), "append", "u").count() == events.count()


def test_long_strings_do_not_exhaust_the_stack(spark):
    """One string of a million characters, of escapes, of quotes, and an unclosed one, each beside brackets that count."""
    n = 1_000_000
    texts = ['{"a":["' + "x" * n + '"]}', '{"a":["' + "\\\\" * n + '"]}', '{"a":["' + '\\"' * n + '"]}', '{"a":["' + "[" * n + '"]}', '[["' + "y" * n, '["' + "\\n" * n + '",[[1]]]']
    got = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").select("i", S.json_depth(F.col("raw")).alias("d"), S.admit(F.col("raw")).alias("v")).orderBy("i").collect()
    assert [r.d for r in got] == [2, 2, 2, 2, 2, 3] and {r.v for r in got} == {"ok"}
