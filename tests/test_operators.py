"""Operators on small literal relations."""

import hashlib
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import numbers as N
from tallyspark.functions import text as T
from tallyspark.operators import aggregates as A
from tallyspark.operators import compare as C
from tallyspark.operators import graph as G
from tallyspark.operators import invariants as I
from tallyspark.operators import rules as R
from tallyspark.operators import windows as X
from tallyspark.plans import tabular, verdict
from tallyspark.plans.falsify import falsifiable


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(df):
    return df.collect()[0]


# comparators

LEFT = [(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)]
KINDS = "o int, t string, v double"


def test_exact(spark):
    e = spark.createDataFrame(LEFT, KINDS)
    assert C.exact(e, e, "o").isEmpty()
    other = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.0), (4, "d", 4.0)], KINDS)
    assert [(r.o, r.column) for r in C.exact(e, other, "o").orderBy("o").collect()] == [(1, "v"), (3, "<row>"), (4, "<row>")]
    with pytest.raises(TypeError):
        C.exact(e, e.withColumn("v", F.col("v").cast("int")), "o")


def test_epsilon(spark):
    e = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, float("nan")), (4, None), (5, float("inf"))], "o int, v double")
    a = spark.createDataFrame([(1, 1.1), (2, 1.3), (3, float("nan")), (4, None), (5, float("inf"))], "o int, v double")
    assert [r.o for r in C.scalar_epsilon(e, a, "o", ["v"], 0.2).orderBy("o").collect()] == [2, 3, 4, 5]
    assert values(C.not_finite(e, ["v"])) == [("v", 2)]


@given(st.lists(st.integers(0, 3), max_size=8), st.randoms(use_true_random=False))
@settings(max_examples=8, deadline=None)
def test_multiset_ignores_order_and_counts(spark, xs, rng):
    ys = xs[:]
    rng.shuffle(ys)
    df = lambda v: spark.createDataFrame([(x,) for x in v], "x int")
    assert C.multiset(df(xs), df(ys)).isEmpty()
    assert values(C.multiset(df([*xs, 1]), df(ys))) == [(1, 1)]


def test_registry():
    for bad in (("nope", {}), ("exact", {}), ("set", {"ordinal": "o"}), ("scalar_epsilon", {"ordinal": "o", "columns": ["v"], "epsilon": float("nan")}), ("scalar_epsilon", {"ordinal": "o", "columns": ["v"], "epsilon": True})):
        with pytest.raises(ValueError):
            C.comparator(bad[0], **bad[1])


def test_text_profiles(spark):
    df = spark.createDataFrame([(1, "  Straße,  café́!\t"), (2, None), (3, "A - B")], "o int, t string")
    assert [r[0] for r in df.orderBy("o").select(T.normalise("t")).collect()] == ["strasse café́".replace("é́", "é́"), None, "a b"]
    other = spark.createDataFrame([(1, "STRASSE café́"), (2, None), (3, "a b")], "o int, t string")
    assert C.text_normalized(df, other, "o", ["t"]).isEmpty()


# aggregates


def test_private_count(spark):
    u = random.Random(3).random()
    noise = -2.0 * (1 if u >= 0.5 else -1) * __import__("math").log(1 - 2 * abs(u - 0.5))
    df = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    r = one(A.private_count(df, {"k": "x"}, 0.5, 1.0, 3))
    assert (r.true_count, r.noised_count) == (2, 2.0 + noise)


def test_rates(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (None, 0, "b"), (2, None, "b")], "x int, y int, g string")
    assert one(A.completeness(df, ["x", "y"])).completeness_pct == 50.0
    assert one(A.duplicate_rate(df, ["x", "y"])).duplicate_pct == 25.0
    assert one(A.positive_rate(df, "y")).positive_pct == pytest.approx(200 / 3)
    assert one(A.disparate_impact(df, "g", "y")).disparate_impact == 0.0
    with pytest.raises(Exception, match="no rates"):
        A.disparate_impact(df.where("g = 'a'"), "g", "y").collect()
    with pytest.raises(Exception, match="nothing"):
        A.conditional_rate(df, F.col("x") == 9, F.col("y") == 1).collect()


def test_auc_with_ties(spark):
    rng = random.Random(1)
    data = [(rng.randint(0, 1), rng.randint(0, 5)) for _ in range(80)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert one(A.roc_auc(spark.createDataFrame(data, "y int, s int"), "y", "s")).auc == pytest.approx(want)
    with pytest.raises(Exception, match="one class"):
        A.roc_auc(spark.createDataFrame([(1, 2)], "y int, s int"), "y", "s").collect()


def test_weakest(spark):
    df = spark.createDataFrame([("a", "hi"), ("a", "lo"), ("b", "hi")], "g string, s string")
    assert values(A.weakest(df, ["g"], "s", ["lo", "hi"])) == [("a", "lo"), ("b", "hi")]
    with pytest.raises(Exception, match="unknown value"):
        A.weakest(df, ["g"], "s", ["lo"]).collect()


# windows


def test_velocity_window_is_half_open(spark):
    at = lambda h, m=0, s=0: datetime(2024, 1, 1 + h // 24, h % 24, m, s)
    df = spark.createDataFrame([("u", at(0), 9), ("u", at(23, 59, 59), 9), ("u", at(24), 9), ("v", at(0), 1)], "k string, t timestamp, a int")
    assert values(X.forward_velocity(df, "k", "t", F.col("a") > 5, 86_400, "n")) == [("u", 2), ("v", 0)]


def test_islands_and_frames(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 5, 5, 5, 0, 5, 0, 5, 5])], "i long, v int").withColumn("k", F.lit(1))
    assert values(X.islands(df, "k", "i", F.col("v") > 1, 2)) == [(1, 1, 4), (1, 7, 9)]
    assert values(X.frames(df, "i", "v", 4)) == [(0, 75), (1, 50)]


def test_counters(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (4,)], "c long").withColumn("g", F.lit("x"))
    assert [(r.c, r.expected) for r in X.counter_gaps(df, ["g"], "c").collect()] == [(2, 3), (4, 3)]
    log = spark.createDataFrame([("s", 1, 5), ("s", 2, 7), ("s", 3, 7), ("s", 4, 6)], "ch string, i int, c long")
    assert [r.i for r in X.not_increasing(log, ["ch"], ["i"], "c").orderBy("i").collect()] == [3, 4]
    assert [r.i for r in X.replays(log, ["ch", "c"], ["i"]).collect()] == [3]


def test_chain_and_tree(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    leaves = [sha(bytes([i])) for i in range(5)]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(leaves)], "c string, i int, leaf string")
    head = "00"
    for x in leaves:
        head = sha((head + x).encode())
    assert one(X.chain_head(df, ["c"], F.col("i"), F.col("leaf"), "00")).head == head
    level = [sha(b"\x01" + bytes.fromhex(x)) for x in leaves]
    while len(level) > 1:
        level = [sha(b"\x00" + bytes.fromhex(level[i]) + bytes.fromhex(level[min(i + 1, len(level) - 1)])) for i in range(0, len(level), 2)]
    trees = spark.createDataFrame([(leaves,), (leaves[:1],), ([],)], "l array<string>").select(X.merkle_root(F.col("l"), levels=4))
    assert [r[0] for r in trees.collect()] == [level[0], sha(b"\x01" + bytes.fromhex(leaves[0])), sha(b"\x01")]


def test_tumbling_floors_before_the_epoch(spark):
    df = spark.createDataFrame([(-1,), (0,), (59_999,), (60_000,)], "ms long")
    assert [r[0] for r in df.select(X.window_index(F.col("ms"), 60_000)).collect()] == [-1, 0, 0, 1]


def test_ranked(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(50)], "id int, s int")
    want = {i: n for n, (_, i) in enumerate(sorted((s, i) for i, s in ((i, (i * 7) % 5) for i in range(50))), 1)}
    assert {r.id: r["rank"] for r in X.ranked(df, [F.col("s"), F.col("id")], 3).collect()} == want


# rules


def test_first_match_and_matrix(spark):
    rules = [("b", [("x", ">", 0)], "yes"), ("a", [("x", ">", 5), ("t", "in", ["u"])], "sure")]
    df = spark.createDataFrame([(9, "u"), (9, None), (-1, "u"), (None, "u")], "x int, t string")
    assert values(R.first_match(df, rules, "no")) == sorted([(9, "u", "a", "sure"), (9, None, "b", "yes"), (-1, "u", None, "no"), (None, "u", None, "no")], key=str)
    assert R.policy_matrix(df, rules).where("verdict <> 'NOT_APPLICABLE'").count() == 3
    with pytest.raises(ValueError):
        R.first_match(df, [("a", [("x", "~", 1)], "v")], "no")


def test_division_tiers_validity(spark):
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, "a")], "e int, i string")
    needs = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "a")], "r string, i string")
    assert values(R.division(facts, needs, ["e"], "i", "r")) == [(1, "r"), (1, "s"), (2, "s")]
    df = spark.createDataFrame([(0.0,), (0.5,), (7.0,)], "v double")
    assert [r[0] for r in df.select(R.tier(F.col("v"), [(0.0, 0.5, "l"), (0.5, 1.0, "m")])).collect()] == ["l", "m", "m"]
    spans = spark.createDataFrame([(1, 0, 5), (2, 3, None)], "ordinal int, start int, end int")
    at = spark.createDataFrame([(4,), (5,), (5,)], "t int")
    assert sorted(r.ordinal for r in R.valid_at(at, "t", spans).collect()) == [1, 2, 2]
    with pytest.raises(Exception, match="no interval"):
        R.valid_at(spark.createDataFrame([(-1,)], "t int"), "t", spans).collect()


def test_resolve(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    corpus = spark.createDataFrame([("a", "text")], "k string, t string")
    assert values(R.resolve(df, corpus, "k", ["t"])) == [("a", "text", True), ("z", None, False)]
    with pytest.raises(Exception, match="ambiguous"):
        R.resolve(df, corpus.union(corpus), "k", ["t"]).collect()


# functions


def test_numbers(spark):
    df = spark.createDataFrame([(5, 2), (7, 2), (4, 3), (0, 9)], "n long, d long")
    assert [r[0] for r in df.select(N.half_up(F.col("n"), F.col("d"))).collect()] == [3, 4, 1, 0]
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(N.half_up(F.lit(-1).cast("long"), 2)).collect()
    assert [r[0] for r in spark.createDataFrame([(-7,), (7,)], "n long").select(N.floor_div(F.col("n"), 2)).collect()] == [-4, 3]
    unit = int.from_bytes(hashlib.sha256(b"x|7").digest()[:8], "big") / 2**64
    assert spark.range(1).select(N.hash_unit(F.lit("x|7"))).first()[0] == unit


def test_sentences(spark):
    text = "One  two. Three 3.5 four!  Fünf? tail"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.sentences(F.col("t"))).collect()]
    assert [(s.start, s.end, s.text) for s in got[0]] == [(0, 8, "One two."), (10, 25, "Three 3.5 four!"), (27, 33, "Fünf?"), (34, 38, "tail")]
    assert got[1] == [] and got[2] is None
    with pytest.raises(Exception, match="no such"):
        df.limit(1).select(T.nth(T.sentences(F.col("t")), 9)).collect()


# graphs, invariants, plans


def test_reachable_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    found = G.reachable(edges, spark.createDataFrame([("a",)], "start string"), 3)
    assert {(r.node, r.depth) for r in found.collect()} == {("b", 1), ("c", 2), ("d", 3)}
    packages = spark.createDataFrame([("r", "h", ["x", "y"]), ("x", "i", ["y"])], "id string, hash string, deps array<string>")
    assert values(G.dependency_closure(packages, "r")) == [("r", 0, "h", 2), ("x", 1, "i", 1), ("y", 1, "", 0)]


def test_closure_broadcasts_nothing(spark, monkeypatch):
    plans = []

    def kept(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint()

    monkeypatch.setattr(G, "cut", kept)
    packages = spark.createDataFrame([(str(i), "h", [str(j) for j in (2 * i, 2 * i + 1) if j < 20]) for i in range(1, 20)], "id string, hash string, deps array<string>")
    found = G.dependency_closure(packages, "1")
    assert {(r.id, r.depth) for r in found.collect()} == {(str(i), i.bit_length() - 1) for i in range(1, 20)}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_closure_has_no_silent_depth(spark):
    packages = spark.createDataFrame([(f"n{i}", "h", [f"n{i + 1}"]) for i in range(4)], "id string, hash string, deps array<string>")
    assert G.dependency_closure(packages, "n0", None).count() == 5 and G.dependency_closure(packages, "n0", 4).count() == 5
    with pytest.raises(ValueError, match="deeper"):
        G.dependency_closure(packages, "n0", 3)


def test_marks_that_touch_digits_end_nothing(spark):
    df = spark.createDataFrame([("It is 3.5 m. Then 7. No! Up..5 a",), (None,)], "t string")
    assert [r[0] for r in df.select(T.segments(F.col("t"))).collect()] == [["It is 3.5 m", "Then 7. No", "Up", ".5 a"], None]


def test_invariants(spark):
    df = spark.createDataFrame([(3, 2, 1, {"a": 1}), (3, 2, 2, {"a": 2}), (3, 2, 1, {"a": 2}), (1, 2, -1, {"a": -1})], "e long, i long, w long, r map<string,long>")
    assert [r.reason for r in I.coverage_sum(df, "e", "i", "w", "r").collect()] == ["issued + withheld <> eligible", "reasons <> withheld", "negative count"]
    sets = spark.createDataFrame([(["a", "b"], ["a"], ["a"]), (["a"], ["b"], []), (["b", "a"], [], [])], "x array<string>, y array<string>, z array<string>")
    assert [r.reason for r in I.subset_chain(sets, "x", "y", "z").collect()] == ["y not in x", "not sorted"]
    par = spark.createDataFrame([("(a(b))",), (")(",), ("(()",), ("",)], "t string")
    assert [r[0] for r in par.select(I.balanced(F.col("t"))).collect()] == [True, False, False, True]
    d = spark.createDataFrame([("p",), ("p",), ("q",)], "id string")
    assert values(I.count_mismatch(d, spark.createDataFrame([("p",), ("r",)], "id string"), "id")) == [("p", 2, 1), ("q", 1, 0), ("r", 0, 1)]


def test_verdicts(spark):
    found = lambda *s: spark.createDataFrame([(f"c{i}", x, "", "", "") for i, x in enumerate(s)], verdict.FINDINGS)
    state = lambda df, g=None: tuple(one(verdict.compose(df, g))[:2])
    assert state(found()) == ("OK", "OK")
    assert state(found("OK", "INCOMPLETE")) == ("ERROR", "INCOMPLETE")
    assert state(found("INCOMPLETE", "REJECT")) == ("REJECT", "REJECT")
    assert state(found("REJECT", "CRASH")) == ("ERROR", "CRASH")
    assert state(found("CRASH", "REJECT"), ["c1"]) == ("REJECT", "REJECT")
    with pytest.raises(Exception, match="unknown severity"):
        state(found("MAYBE"))


SALES = [("north", "7", "70"), ("south", "10", "5"), ("north", "3", "30")]
SPEC = {"select": [{"kind": "column", "name": "region"}, {"kind": "agg", "func": "sum", "column": "units", "alias": "u"}, {"kind": "agg", "func": "count", "column": "*", "alias": "n"}], "group_by": ["region"], "order_by": ["u"]}


def test_declared_aggregate_and_tampering(spark):
    df = spark.createDataFrame(SALES, "region string, units string, revenue string")
    assert [tuple(r) for r in tabular.aggregate(df, SPEC).collect()] == [("north", 10, 2), ("south", 10, 1)]
    want = hashlib.sha256(b"region,u,n\nnorth,10,2\nsouth,10,1").hexdigest()
    assert one(tabular.result_digest(df, SPEC)).result_sha == want
    for tampered in (SALES[1:], [*SALES, SALES[0]], [("north", "8", "70"), *SALES[1:]]):
        assert one(tabular.result_digest(spark.createDataFrame(tampered, df.schema), SPEC)).result_sha != want
    for bad in ({"kind": "agg", "func": "avg", "column": "units", "alias": "x"}, {"kind": "column", "name": "units"}):
        with pytest.raises(ValueError):
            tabular.aggregate(df, SPEC | {"select": [bad]})
    bound = verdict.Binding(lambda s, sources, p: tabular.aggregate(sources["sales"], p), C.multiset, SPEC)
    honest = tabular.aggregate(df, SPEC)
    wrong = honest.withColumn("u", F.col("u") + 1)
    run = lambda *outputs: one(verdict.compose(verdict.verify(spark, {"sales": df}, list(outputs), {"table": bound}))).verdict
    assert run(verdict.Output("a", "table", honest)) == "OK"
    assert run(verdict.Output("a", "table", wrong)) == "REJECT"
    assert run(verdict.Output("a", "other", honest)) == "ERROR"
    assert run(verdict.Output("a", "table", honest), verdict.Output("a", "table", honest)) == "REJECT"


def test_falsifiable(spark):
    out = {r.rule_id: r.falsifiable for r in falsifiable(spark, {"a": "x > 1", "b": "x > 9", "c": "x + 1 > 2", "d": "not (x == x)", "e": "1 == 1", "f": "x >"}).collect()}
    assert out == {"a": True, "b": False, "c": None, "d": False, "e": True, "f": None}


def test_canonical_json_sorts_and_keeps_nulls(spark):
    import json

    from tallyspark.operators.records import canonical_json

    fields = {"b": "é \"q\"\n/", "a": None, "": "x", "c": "\x1f\x0b\x1a\x1f \\u001F \\\x1f\x00\x7f"}
    frame = spark.createDataFrame([(fields,), ({},)], "m map<string,string>")
    got = [r[0] for r in frame.select(canonical_json(F.col("m"))).collect()]
    assert got == [json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for m in (fields, {})]


def test_replay_of_odd_logs(spark):
    from tallyspark.operators.records import replay

    log = [
        ("ok", 1, "CREATE", {"a": "1", "b": "2"}), ("ok", 2, "AMEND", {"a": None}), ("ok", 3, "DELETE", {"b": "9"}),
        ("early", 1, "AMEND", {"a": "1"}), ("early", 2, "CREATE", {"a": "2"}), ("twice", 1, "CREATE", {}), ("twice", 2, "CREATE", {}),
        ("none", 1, "LOG", None), ("odd", 1, "CREATE", {}), ("odd", 2, None, {}), ("bare", 1, "CREATE", None), ("empty", 1, "CREATE", {}),
    ]
    frame = spark.createDataFrame(log, "id string, seq int, op string, patch map<string,string>")
    got = {r.id: (r.status, r.state) for r in replay(frame, "id", ["seq"], "op", "patch").collect()}
    assert got == {
        "ok": ("replayed", '{"a":null,"b":"2"}'), "early": ("amend before create", None), "twice": ("second create", None), "none": ("no create", None),
        "odd": ("unknown operation", None), "bare": ("no fields", None), "empty": ("replayed", "{}"),
    }


def test_key_of_two_records_fails(spark):
    from tallyspark.operators.records import resolve_many

    records = lambda *rows: spark.createDataFrame(list(rows), "id int, cites array<string>")
    asked = lambda corpus: resolve_many(spark.createDataFrame([("B 2",), ("c",)], "cite string"), corpus, "cite", "id", "cites", ["id"]).collect()
    with pytest.raises(Exception, match="key of two records"):
        asked(records((1, ["b 2"]), (2, [" B  2"])))
    assert sorted((r.cite, r.id, r.resolved) for r in asked(records((1, ["A 1", "b 2", "B 2"]), (2, ["d"])))) == [("B 2", 1, True), ("c", None, False)]


def test_opaque_fragments_have_tags_of_their_own(spark):
    from tallyspark.operators.records import fragments

    made = ['{"kind":"opaque","source_cid":"c","kind_tag":"%s","locator":{}}' % t for t in ("mine", "opaque", "page_coord", "")] + [None, "no json"]
    got = [r.reason for r in fragments(spark.createDataFrame([(m,) for m in made], "text string"), "text").collect()]
    assert got == [None, "out of bounds", "out of bounds", "out of bounds", "no kind", "no kind"]


def test_quotes_short_and_long_against_plain_containment(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "bb", "", "c,", "é"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(60, None), (61, "x" * 50_000), (1, "a bb a bb a"), (None, "c, é a  bb bb")]
    quotes = [(i, text(rng.randrange(0, 9))) for i in range(50)] + [(50, None), (51, ""), (52, docs[3][1][2:-1]), (53, docs[3][1][2:-1]), (54, "x" * 40)]
    got = R.quoted(spark.createDataFrame(quotes, "item_id int, quote string"), spark.createDataFrame(docs, "doc_id int, whole string"), "item_id", block=20)
    want = [(q, d) for q, s in quotes for d, t in docs if s and t and s in t]
    assert sorted(((r.item_id, r.doc_id) for r in got.collect()), key=str) == sorted(want, key=str)
    assert R.quoted(spark.createDataFrame([], "item_id int, quote string"), spark.createDataFrame(docs, "doc_id int, whole string"), "item_id").isEmpty()


def test_polygons_against_shared_edges(spark):
    """Every half cell of a square split in two lies in exactly one half; no vertices hold nothing."""
    from tallyspark.operators.shapes import inside

    grid = spark.range(-3, 25).selectExpr("id as x").crossJoin(spark.range(-3, 25).selectExpr("id as y"))
    square, lower, upper = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (10, 0), (10, 10)], [(0, 0), (10, 10), (0, 10)]
    x, y = F.col("x"), F.col("y")
    out = grid.select("x", "y", *[inside(x, y, p).cast("int").alias(n) for n, p in (("s", square), ("l", lower), ("u", upper), ("none", []), ("line", [(0, 0), (5, 5)]), ("back", square[::-1]))]).collect()
    assert all(r.s == r.l + r.u == r.back == int(0 <= r.x < 20 and 0 <= r.y < 20) and r.none == 0 == r.line for r in out)


def test_rules_over_a_table_of_bounds(spark):
    from tallyspark.plans.falsify import can_fire

    df = spark.createDataFrame([(1, 0), (2, 0), (-3, None)], "a int, b int")
    got = df.select(can_fire("x > a", ["x"]), can_fire("x == y and x != y", ["x", "y"]), can_fire("a > b", []), can_fire("not x < a or b == 0", ["x"])).collect()
    assert [tuple(r) for r in got] == [(True, False, True, True), (False, False, True, True), (True, False, False, True)]
