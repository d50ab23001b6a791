import json
import math
import random

from pyspark.sql import functions as F

from tallyspark.operators.nested import admit_nested, canonical, parse_exact

CHARS = ['a', 'B', '"', '\\', '/', '~', '\n', '\t', '\x00', '\x1f', '\x7f', 'é', '', '😀', ' ', "'", '$', '.']


def scalar(rng):
    pick = rng.randrange(9)
    return (
        rng.randint(-(10**rng.randint(1, 30)), 10 ** rng.randint(1, 30)) if pick == 0 else
        rng.uniform(-1, 1) * 10 ** rng.randint(-320, 308) if pick == 1 else
        round(rng.uniform(-1e6, 1e6), rng.randint(0, 6)) if pick == 2 else
        rng.choice([0.0, -0.0, 5e-324, 1e16, 1e-5, 1e22, 123456789012345680.0, 2e-3, 9007199254740993.0, 1e100, 2.2250738585072014e-308]) if pick == 3 else
        rng.choice([True, False, None]) if pick == 4 else
        rng.choice([{}, [], "", "NaN", "Infinity"]) if pick == 5 else
        "".join(rng.choice(CHARS) for _ in range(rng.randint(0, 8)))
    )


def value(rng, depth):
    if depth and rng.random() < 0.6:
        n = rng.randint(0, 5)
        return [value(rng, depth - 1) for _ in range(n)] if rng.random() < 0.5 else {"".join(rng.choice(CHARS) for _ in range(rng.randint(0, 3))): value(rng, depth - 1) for _ in range(n)}
    return scalar(rng)


def plain(obj):
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_equals_json_dumps(spark):
    """About 10^5 scalars in random values, written with random spaces and escapes."""
    rng = random.Random(0)
    values = [value(rng, 4) for _ in range(9000)] + [[scalar(rng) for _ in range(60)] for _ in range(1500)]
    raw = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for v in values]
    got = {r.i: r.canonical for r in canonical(spark.createDataFrame(list(enumerate(raw)), "i int, raw string"), "i", "raw").collect()}
    wrong = [(raw[i], got[i], plain(v)) for i, v in enumerate(values) if got[i] != plain(v)]
    assert not wrong, (len(wrong), wrong[:3])


SINGLE = [
    ("[NaN, Infinity, -Infinity, 1e999]", "[NaN,Infinity,-Infinity,Infinity]"), ("1.50", "1.5"), (" 7 ", "7"), ('"x" ', '"x"'), ("-0", "0"), ("1E3", "1000.0"), ("[[]] x", None), ("[1] , [2]", None),
    ("1 2", None), ('{"a":1} xyz', None), ("[1]]", None), ("", None), (None, None), ('{"a":1,"a":2}', None), ("9" * 39, None), ("[" * 65 + "]" * 65, None), ("[" * 20 + "]" * 20, "[" * 20 + "]" * 20), ("null", "null"),
]


def test_single_texts(spark):
    docs = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(SINGLE)], "i int, raw string")
    got = {r.i: r.canonical for r in canonical(docs, "i", "raw").collect()}
    assert [got[i] for i in range(len(SINGLE))] == [want for _, want in SINGLE]


def reference_walk(obj, max_depth, max_entries):
    """Breaches by breadth: (depth, path, what)."""
    level, out, count = [("", obj)], [], 0
    for depth in range(1, max_depth + 2):
        below = []
        for path, x in level:
            count += 1
            if isinstance(x, dict | list):
                if len(x) > max_entries:
                    out.append((depth, path, "too_many", len(x)))
                else:
                    below += [(f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}", v) for k, v in (x.items() if isinstance(x, dict) else enumerate(x))]
            elif isinstance(x, float) and not math.isfinite(x):
                out.append((depth, path, "not_finite", 1))
        level = below
    return (*min(out)[1:],) if out else (None, "ok", count)


def test_admission_against_a_plain_walk(spark):
    rng = random.Random(2)
    values = [value(rng, 4) for _ in range(400)]
    values += [{"a": [1, {"b/c": float("nan")}], "z": float("inf")}, [[1, 2, 3, 4, 5, 6], float("inf")], {"k": {"~": [[], [float("-inf")]]}}]
    docs = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, raw string")
    got = {r.i: (r.path, r.verdict, r.found) for r in admit_nested(docs, "i", "raw", max_entries=4).collect()}
    assert got == {i: reference_walk(v, 64, 4) for i, v in enumerate(values)}


def test_early_verdicts_and_hostile_texts(spark):
    n = 200_000
    texts = ["[" * 65 + "]" * 65, '"' + "x" * 300, "]]][[" , None, "[" * n, '{"a":' * 3 + "1", "[" + "1," * 100 + "1]", '"' + "\\" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = {r.i: (r.verdict, r.found) for r in admit_nested(docs, "i", "raw", max_bytes=250, max_depth=64).collect()}
    assert got[0] == ("too_deep", 65) and got[1][0] == "too_large" and {got[i][0] for i in (2, 3, 5)} == {"not_json"} and got[4] == ("too_large", n) and got[6] == ("ok", 102) and got[7][0] == "too_large"
    assert admit_nested(docs.limit(0), "i", "raw").count() == 0


def test_a_wide_object(spark):
    """Many distinct keys: scalars carry no copy of them."""
    wide = {f"key{i}": i if i % 2 else {"n": i + 0.5} for i in range(3000)}
    docs = spark.createDataFrame([(1, json.dumps(wide))], "i int, raw string")
    (got,) = canonical(docs, "i", "raw").collect()
    assert got.canonical == plain(wide)
    assert docs.select(parse_exact(F.col("raw")).isNotNull().alias("ok")).first().ok


def test_canonical_is_one_pass(spark):
    """No level is a job, a shuffle or a join, however deep the texts are."""
    docs = spark.range(0, 400, 1, 4).select("id", F.concat(F.lit('{"b":[[[{"a":'), F.col("id").cast("string"), F.lit(".50}]]]}")).alias("raw"))
    got = canonical(docs, "id", "raw")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and got.rdd.getNumPartitions() == 4
    assert {r.id: r.canonical for r in got.collect()} == {i: '{"b":[[[{"a":%d.5}]]]}' % i for i in range(400)}


def test_texts_at_the_limits(spark):
    """Nulls among keys, equal keys, many brackets that aren't deep, brackets inside strings, halves of surrogate pairs, words behind digits."""
    texts = [
        ("a", "[" + "[]," * 100 + "[]]", "[" + "[]," * 100 + "[]]"), ("a", "[[]]", "[[]]"), (None, "{}", "{}"), ("b", '"' + "[" * 100 + '"', '"' + "[" * 100 + '"'), ("c", "[" * 64 + "]" * 64, "[" * 64 + "]" * 64),
        ("d", "[" * 65 + '"x"' + "]" * 65, None), ("e", '["\\ud800", "\\ud83d\\ude00"]', '["?","😀"]'), ("f", '{"\\udc00":1,"=":2,"0":3}', '{"0":3,"=":2,"?":1}'), ("g", "[1Infinity]", None), ("h", "[" + "9" * 38 + ",-" + "9" * 38 + "]", "[" + "9" * 38 + ",-" + "9" * 38 + "]"), ("i", '["\t"]', None), ("j", "-" + "9" * 39, None), ("k", '[{"a":1,"\\u0061":2}]', None),
    ]
    docs = spark.createDataFrame([t[:2] for t in texts], "k string, raw string").repartition(3)
    got = sorted(((r.k, r.canonical) for r in canonical(docs, "k", "raw").collect()), key=str)
    assert got == sorted(((k, want) for k, _, want in texts), key=str)
