"""Every query that has a statement against DuckDB on small tables; those without one against plain code."""

import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyspark.operators import shapes
from tallyspark.operators.shapes import OUTSIDE, _bioes, _biases, decode
from tallyspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(table):
    names = sorted(table.column_names)
    plain = [[round(v, 9) if isinstance(v, float) else v for v in table[c].to_pylist()] for c in names]
    return names, sorted(map(repr, zip(*plain, strict=True)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    got = rows(QUERIES[name](spark, SF).toArrow())
    want = rows(duck.execute(ORACLES[name]).to_arrow_table())
    assert got == want


def test_every_query_has_a_statement_or_a_test_here():
    assert set(QUERIES) - set(ORACLES) == {"q_char_hash", "q_redact", "q_viterbi", "q_fea"}


def test_char_hash(spark):
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in QUERIES["q_char_hash"](spark, SF).collect():
        assert r.affinity == sum(zlib.crc32(c.encode()) % 32 - 16 for c in parts[r.p_partkey])


def test_redact(spark):
    out = QUERIES["q_redact"](spark, SF).collect()
    for r in out:
        assert not re.search(r"\d{3,}|\bth\w{9,}", re.sub(r"\[REDACTED:\w+\]", "", r.redacted)) and r.redacted.count("[REDACTED:") == r.n_spans
    assert any(r.n_spans for r in out)


def test_viterbi_is_best_of_all_valid_sequences():
    valid, begin, end = _bioes(1)
    assert valid.shape == (5, 5)
    rng = np.random.default_rng(0)
    wide, start, stop = _bioes()
    bias = rng.normal(size=6).tolist()
    step = _biases(bias)
    for _ in range(5):
        logits = rng.normal(size=(3, 33))
        best = max(
            (logits[0, a] + step[a, b] + logits[1, b] + step[b, c] + logits[2, c], (a, b, c))
            for a, b, c in itertools.product(range(33), repeat=3)
            if start[a] and wide[a, b] and wide[b, c] and stop[c]
        )[1]
        spans, at = [], 0
        for i, s in enumerate(best):
            if s != OUTSIDE and s % 4 in (0, 3):
                at = i
            if s != OUTSIDE and s % 4 in (2, 3):
                spans.append((at, i + 1, s // 4))
        assert decode(logits, bias) == spans


def test_viterbi_query(spark):
    out = QUERIES["q_viterbi"](spark, SF).collect()
    assert out and all(0 <= r.token_start < r.token_end <= 8 and re.fullmatch("c[0-7]", r.category) for r in out)


def test_mesh_under_tension(spark):
    """A plate held on its left side and pulled evenly to the right has load over cross section everywhere."""
    prices = {r.p_partkey: r.p_retailprice for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in QUERIES["q_fea"](spark, SF).collect():
        assert r.max_stress == pytest.approx(prices[r.p_partkey] / 0.1, rel=1e-4)


def test_meshes_are_solved_together_and_in_many_tasks(spark, monkeypatch):
    assert QUERIES["q_fea"](spark, SF).rdd.getNumPartitions() == 4
    solved, solve = [], shapes._stress
    monkeypatch.setattr(shapes, "_stress", lambda *a: solved.append(len(a[0])) or solve(*a))
    held = [{"dof": d, "value": 0.0} for d in (0, 1, 6)]
    plate = lambda load, **other: {"nodes": [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], "elements": [[0, 1, 2], [0, 2, 3]], "fixed": held, "loads": [{"dof": d, "value": load / 2} for d in (2, 4)], "e": 1e5, "nu": 0.3, "thickness": 0.1} | other
    triangle = plate(0, nodes=[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]], elements=[[0, 1, 2]], fixed=[{"dof": d, "value": 0.0} for d in (0, 1, 4)], loads=[{"dof": 2, "value": 1.0}])
    rows = [plate(float(i)) if i % 3 else triangle for i in range(1000)] + [plate(5.0, elements=[[0, 1, 3], [1, 2, 3]], loads=[{"dof": d, "value": 5.0 / n} for d, n in ((2, 2), (4, 4), (4, 4))])]
    got = shapes._stresses(pa.RecordBatch.from_pylist(rows))
    assert sorted(solved) == [1, 334, 666]
    assert got[0] == pytest.approx(shapes._stresses(pa.RecordBatch.from_pylist([triangle]))[0])
    assert got[1:1000].tolist() == pytest.approx([10.0 * i if i % 3 else got[0] for i in range(1, 1000)]) and got[1000] == pytest.approx(50)
    for bad in ({"nodes": [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]]}, {"elements": [[0, 1], [2, 0, 2, 3]]}, {"loads": [{"dof": 2, "value": None}]}, {"nodes": None}):
        with pytest.raises(ValueError):
            shapes._stresses(pa.RecordBatch.from_pylist([plate(1.0), plate(1.0, **bad)]))
