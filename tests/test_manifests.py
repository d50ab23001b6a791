"""One bundle for each check, whole but for one thing."""

import hashlib

from tallyspark.operators.manifests import Manifests, first_faults, manifest_faults
from tallyspark.queries import QUERIES

SCHEMAS = {
    "bundles": "bundle string, policy_sha string, decision_log string, trace string, trace_log string, mode string, header string, header_leaf string",
    "files": "bundle string, path string, cid string",
    "snapshots": "bundle string, cid string, path string",
    "ingests": "bundle string, path string, policy_sha string",
    "anchors": "bundle string, name string, fragment string",
    "attributes": "bundle string, cid string, publication_class string, signed boolean, signing_key string, issuer_verified boolean, issuer string",
    "decisions": "bundle string, path string, cid string",
    "traces": "bundle string, path string, trace string, candidates array<string>, context array<string>",
    "outputs": "bundle string, output string, trace string, emitted_at string, retrieved array<string>, injected array<string>, quoted array<string>",
}


def whole(b):
    leaf = hashlib.sha256(b.encode()).hexdigest().upper()
    return {
        "bundles": [dict(bundle=b, policy_sha="AB", decision_log="d", trace="t", trace_log="r", mode="verified_extractive", header=b, header_leaf=leaf)],
        "files": [dict(bundle=b, path=p, cid=c) for p, c in (("s1", "C1"), ("s2", "c2"), ("d", ""), ("r", ""))],
        "snapshots": [dict(bundle=b, cid="c1", path="s1"), dict(bundle=b, cid="c2", path="s2")],
        "ingests": [dict(bundle=b, path="i", policy_sha="ab"), dict(bundle=b, path="j", policy_sha=None)],
        "anchors": [dict(bundle=b, name="a", fragment='{"kind":"byte_offset","source_cid":"c1","start":0,"end":3}')],
        "attributes": [dict(bundle=b, cid="c1", publication_class="press", signed=True, signing_key="k", issuer_verified=False, issuer=None)],
        "decisions": [dict(bundle=b, path="d", cid="c1")],
        "traces": [dict(bundle=b, path="r", trace="t", candidates=["c1", "c2"], context=["c1"])],
        "outputs": [dict(bundle=b, output="o", trace="t", emitted_at="now", retrieved=["c1", "c2"], injected=["c1"], quoted=["c1"])],
    }


def put(table, row=0, **values):
    return lambda m: m[table][row].update(values)


CASES = {
    "whole": (lambda m: None, None, 0),
    "no_policy": (put("bundles", policy_sha=None), (6, "no policy"), 1),
    "gone": (lambda m: m["files"].pop(1), (7, "missing"), 1),
    "gone_and_anchored": (lambda m: m["files"].pop(0), (7, "missing"), 2),
    "changed": (put("files", 1, cid="c3"), (7, "address differs"), 1),
    "drift": (put("ingests", policy_sha="cd"), (8, "another policy"), 1),
    "anchor": (put("anchors", fragment="{}"), (9, "no kind"), 1),
    "class": (put("attributes", publication_class=None), (11, "unknown class"), 1),
    "key": (put("attributes", signing_key=""), (11, "signed without a key"), 1),
    "issuer": (put("attributes", issuer_verified=True), (11, "verified without an issuer"), 1),
    "no_decision": (lambda m: m["decisions"].clear(), (12, "no decision"), 1),
    "no_decision_log": (lambda m: m["files"].pop(2), (12, "no log"), 1),
    "no_trace_log": (lambda m: (m["outputs"].clear(), put("bundles", trace_log=None)(m)), (13, "no log named"), 1),
    "no_trace": (lambda m: (m["outputs"].clear(), m["traces"].clear()), (14, "no trace"), 1),
    "two_traces": (lambda m: (m["outputs"].clear(), m["traces"].append(dict(m["traces"][0]))), (14, "ambiguous trace"), 1),
    "astray": (lambda m: (m["snapshots"].pop(0), m["anchors"].clear()), (11, "no snapshot"), 2),
    "half_output": (put("outputs", emitted_at=None), (16, "missing field"), 1),
    "other_sets": (put("outputs", injected=["c1", "c2"]), (16, "stored differs"), 1),
    "no_mode": (put("bundles", mode=None), (17, "no mode"), 1),
    "mode": (put("bundles", mode="loud"), (18, "unknown mode"), 1),
    "no_quotes": (put("outputs", quoted=[]), (19, "nothing quoted"), 1),
    "leaf": (put("bundles", header="x"), (20, "header differs"), 1),
    "bare": (lambda m: (put("bundles", policy_sha=None, decision_log=None, trace=None, trace_log=None, mode=None, header=None, header_leaf=None)(m), [m[t].clear() for t in m if t != "bundles"]), None, 0),
}


def test_each_check_finds_its_own_fault(spark):
    rows = {t: [] for t in SCHEMAS}
    for name, (damage, _, _) in CASES.items():
        manifest = whole(name)
        damage(manifest)
        for t in rows:
            rows[t] += manifest[t]
    frames = {t: spark.createDataFrame([tuple(r[c.split()[0]] for c in s.split(", ")) for r in rows[t]], s) for t, s in SCHEMAS.items()}
    m = Manifests(**frames)
    faults = manifest_faults(m).collect()
    got = {r.bundle: (r.number and (r.number, r.reason), r.n_faults) for r in first_faults(m.bundles, spark.createDataFrame(faults)).collect()}
    assert got == {name: (first, n) for name, (_, first, n) in CASES.items()}
    assert {(r.bundle, r.subject) for r in faults if r.number in (10, 15)} == {("gone_and_anchored", "a"), ("astray", "c1")}


def test_no_bundles(spark):
    m = Manifests(**{t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()})
    assert first_faults(m.bundles, manifest_faults(m)).collect() == []


def test_what_many_checks_read_is_made_once(spark):
    plan = QUERIES["q_manifest_deep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "c_custkey" not in plan and plan.count("FileScan parquet") <= 4
