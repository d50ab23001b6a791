"""Files written, stored, listed, sealed and read by ranges, over several tasks."""

import hashlib
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import bundles as B
from tallyspark.sources import files as S
from tallyspark.sources import ranges as R


def on_disk(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def frame(spark, files, parts=4):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary").repartition(parts)


FILES = {f"data/{i % 7}/f{i}.bin": bytes([i % 256]) * i for i in range(60)} | {"spec/a.json": b"{}", "é/ü.txt": b"x", "empty": b""}


def test_a_bundle_is_its_manifest(spark, tmp_path):
    root = str(tmp_path / "b")
    B.write_bundle(frame(spark, FILES), root, {"schema_version": "1", "zone": {"b": 1, "a": [1]}, "aa": None})
    there = on_disk(root)
    text = there.pop("manifest.json").decode()
    assert there == FILES
    digests = {p: hashlib.sha256(c).hexdigest() for p, c in FILES.items()}
    want = {"schema_version": "1", "zone": {"b": 1, "a": [1]}, "aa": None, "files": {p: d for p, d in digests.items() if not p.startswith("spec/")}, "spec_files": {"a.json": digests["spec/a.json"]}}
    assert text == json.dumps(want, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    assert {r.path: r.sha256 for r in B.read_manifest(spark, root).collect()} == digests
    assert B.bundle_faults(spark, root).count() == 0 and os.listdir(tmp_path) == ["b"]


def test_faults_of_a_bundle(spark, tmp_path):
    root = tmp_path / "b"
    B.write_bundle(frame(spark, FILES), str(root))
    (root / "data/1/f1.bin").write_bytes(b"other")
    (root / "data/2/f2.bin").unlink()
    (root / "data/new").write_bytes(b"")
    (root / "empty").unlink()
    os.symlink("data/3/f3.bin", root / "empty")
    assert {r.path: r.fault for r in B.bundle_faults(spark, str(root)).collect()} == {"data/1/f1.bin": "changed", "data/2/f2.bin": "missing", "data/new": "extra", "empty": "is link"}


@pytest.mark.parametrize("path", ["/x", "a/../b", "a//b", "./a", "a/", "", "a\\b", "C:/x", "manifest.json", "bundle.dsse.json", "a\x00b", None])
def test_paths_that_are_refused(path):
    assert B.path_fault(path)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    for bad in ({"ok": b"1", "../out": b"2"}, {"ok": b"1", "manifest.json": b"2"}):
        with pytest.raises(Exception):
            B.write_bundle(frame(spark, FILES | bad), str(tmp_path / "b"))
    twice = frame(spark, {"same": b"1"}).unionByName(frame(spark, {"same": b"2"}))
    with pytest.raises(Exception, match="two rows have the path"):
        B.write_bundle(twice, str(tmp_path / "b"))
    assert os.listdir(tmp_path) == []
    B.write_bundle(frame(spark, {}), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none/manifest.json").read_text()) == {"files": {}, "spec_files": {}}
    with pytest.raises(Exception, match="FileExistsError"):
        B.write_bundle(frame(spark, FILES), str(tmp_path / "none"))


def test_store(spark, tmp_path):
    root = str(tmp_path / "s")
    contents = spark.createDataFrame([(bytearray(str(i % 50).encode()),) for i in range(200)] + [(None,)], "content binary").repartition(6)
    for _ in range(2):
        put = B.put_all(contents, root).collect()
        assert len(put) == 50 and all(r.cid == "sha256:" + hashlib.sha256(open(f"{root}/{r.path}", "rb").read()).hexdigest() for r in put)
    os.makedirs(f"{root}/sha256/zz")
    for wrong in ("sha256/zz/zz", "stray", f"sha256/{'a' * 64}"):
        open(f"{root}/{wrong}", "w").close()
    assert {(r.cid, r.path) for r in B.stored(spark, root).collect()} == {(r.cid, r.path) for r in put}
    got = B.get_all(spark.createDataFrame([(r.cid, r.size) for r in put], "cid string, size long"), root).collect()
    assert sorted(r.content.decode() for r in got) == sorted(map(str, range(50))) and all(len(r.content) == r.size for r in got)
    for bad in ("sha256:" + "0" * 64, "sha256:short", "md5:00", None):
        with pytest.raises(Exception):
            B.get_all(spark.createDataFrame([(bad,)], "cid string"), root).collect()
    with open(f"{root}/{put[0].path}", "w") as f:
        f.write("changed")
    with pytest.raises(Exception, match="stored with other bytes"):
        B.put_all(contents, root)
    assert open(f"{root}/{put[0].path}").read() == "changed"


def test_equal_contents_touch_the_store_once(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(B, "cut", lambda df: seen.append(df) or df.checkpoint())
    contents = spark.range(0, 20_000, 1, 8).select(F.concat(F.lit("kind "), (F.col("id") % 30).cast("string")).alias("content"))
    put = B.put_all(contents, str(tmp_path / "s"))
    assert put.count() == put.select("cid").distinct().count() == 30
    seen[0].collect()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("MapInArrow") < plan.index("HashAggregate")


def test_cids(spark):
    texts = ["sha256:" + "a" * 64, "sha256:" + "a" * 63, "sha256:" + "A" * 64, "md5:0a", "sha256:", ":aa", "sha256:" + "a" * 64 + "\n", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", B.valid_cid(F.col("t")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, False, False, True, False, False, False, False]


def test_listing_and_sealing(spark, tmp_path):
    root = tmp_path / "r"
    (root / "a/b/c").mkdir(parents=True)
    for i in range(30):
        (root / "a/b" / f"f{i}").write_bytes(os.urandom(i * 1000))
    os.symlink("b", root / "a/link")
    os.mkfifo(root / "a/pipe")
    nodes = {r.path: r.kind for r in B.listing(spark, str(root)).collect()}
    assert nodes == {"a": "folder", "a/b": "folder", "a/b/c": "folder", "a/link": "link", "a/pipe": "other"} | {f"a/b/f{i}": "file" for i in range(30)}
    files = B.listing(spark, str(root)).where("kind = 'file'").repartition(5)
    sealed = B.sealed_copy(files, str(root), str(tmp_path / "sealed")).collect()
    assert {r.path: r.sha256 for r in sealed} == {f"a/b/f{i}": hashlib.sha256((root / "a/b" / f"f{i}").read_bytes()).hexdigest() for i in range(30)}
    assert on_disk(tmp_path / "sealed") == {f"a/b/{p}": c for p, c in on_disk(root / "a/b").items()}
    for bad in ("a/link", "a/link/f1", "a/pipe", "../r/a/b/f1", "a/b"):
        with pytest.raises(Exception):
            B.sealed_copy(spark.createDataFrame([(bad,), ("a/b/f1",)], "path string"), str(root), str(tmp_path / "no"))
    assert sorted(os.listdir(tmp_path)) == ["r", "sealed"]
    assert B.listing(spark, str(root / "a/b/c")).count() == 0


def test_digests_of_one_folder_are_many_tasks(spark, tmp_path):
    (tmp_path / "r/a").mkdir(parents=True)
    for i in range(40):
        (tmp_path / "r/a" / f"f{i}").write_bytes(bytes([i]) * i)
    files = B.listing(spark, str(tmp_path / "r")).where("kind = 'file'").coalesce(1)
    got = B.with_digests(files, str(tmp_path / "r"))
    assert got.rdd.getNumPartitions() == 4
    assert {r.path: (r.size, r.sha256) for r in got.collect()} == {f"a/f{i}": (i, hashlib.sha256(bytes([i]) * i).hexdigest()) for i in range(40)}


@pytest.mark.parametrize(("width", "signed"), [(1, "true"), (1, "false"), (2, "true"), (4, "false"), (8, "true")])
def test_ranges_of_one_file_are_many_tasks(spark, tmp_path, width, signed):
    data = os.urandom(8 * 1000)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.bin").write_bytes(data)
    (tmp_path / "d/_hidden").write_bytes(b"123")
    df = R.read_fixed_width(spark, str(tmp_path / "d"), width, signed=signed, range_bytes=999)
    code = {1: "b", 2: "h", 4: "i", 8: "q"}[width]
    want = struct.unpack(f"<{len(data) // width}{code if signed == 'true' else code.upper()}", data)
    assert [r.v for r in df.orderBy("i").collect()] == list(want) and {r.path for r in df.select("path").distinct().collect()} == {"x.bin"}
    assert df.rdd.getNumPartitions() >= 8


def test_many_small_files_are_few_tasks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    files = {f"f{i:05}": [i % 300 - 7 + k for k in range(i % 5)] for i in range(3000)} | {"g": list(range(-100, 200))}
    for name, values in files.items():
        (tmp_path / "d" / name).write_bytes(struct.pack(f"<{len(values)}h", *values))
    df = R.read_fixed_width(spark, str(tmp_path / "d"), 2, range_bytes=8)
    assert 4 <= df.rdd.getNumPartitions() <= 80
    assert sorted((r.path, r.i, r.v) for r in df.collect()) == [(name, i, v) for name, values in sorted(files.items()) for i, v in enumerate(values)]


def test_large_ranges_are_tasks_of_their_own():
    pieces = [("p", "n", at, at + R.RANGE_BYTES) for at in range(0, 300 * R.RANGE_BYTES, R.RANGE_BYTES)]
    assert [p.pieces for p in R._packed(pieces)] == [[p] for p in pieces] and R._packed([]) == []


def test_logs(spark, tmp_path):
    log = str(tmp_path / "status")
    event = "event_type string, source_id string, prior_sha string, new_sha string, detected_at string, metadata map<string,string>"
    good = spark.createDataFrame([("RETRACT", "s", None, "n", "2024-01-01T00:00:00Z", {"k": "v"})], event)
    S.append_log(good, log, "status")
    S.append_log(good, log, "status")
    line = '{"detected_at":"2024-01-01T00:00:00Z","event_type":"RETRACT","metadata":{"k":"v"},"new_sha":"n","prior_sha":null,"source_id":"s"}'
    assert [r.value for r in spark.read.text(log).collect()] == [line, line]
    for bad in (good.withColumn("event_type", F.lit("OTHER")), good.withColumn("source_id", F.lit(None).cast("string")), good.drop("metadata"), good.withColumn("x", F.lit(1))):
        with pytest.raises(ValueError):
            S.append_log(bad, log, "status")
    assert spark.read.text(log).count() == 2
    chunks = "array<struct<source_cid:string,fragment:string,rank:long>>"
    shape = f"trace_id string, retriever_name string, retriever_version string, query string, candidate_set array<string>, rankings array<struct<score:double,source_cid:string>>, selected_chunks {chunks}, context_window array<string>, model_router_version string, captured_at string"
    trace = lambda key, candidates, chosen, context: spark.createDataFrame([(key, "r", "1", "q", candidates, [(0.5, "a")], [(c, "f", 1) for c in chosen], context, "m", "t")], shape)
    traces = str(tmp_path / "traces")
    S.append_log(trace("1", ["a", "b"], ["a"], ["a"]), traces, "trace")
    for bad in (trace("1", ["a"], ["a"], ["a"]), trace("2", ["b"], ["a"], ["a"]), trace("2", ["a", "b"], ["a"], ["b"])):
        with pytest.raises(ValueError):
            S.append_log(bad, traces, "trace")
    assert spark.read.json(traces).count() == 1
