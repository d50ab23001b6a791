"""Combinations against all of them, patterns against the standard library's, owners by hand."""

import fnmatch
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.combine import best_combinations, status_counts
from tallyspark.operators.ownership import checked, conserve, glob_regex, ignore_conflicts, ignored_by


def _sides(spark, rng, sizes):
    rows = [[(f"{'abc'[i]}{j}", rng.randrange(4), None if rng.random() < 0.05 else rng.randrange(5)) for j in range(n)] for i, n in enumerate(sizes)]
    return rows, [spark.createDataFrame(r, "key string, x long, y long") for r in rows]


@pytest.mark.parametrize("sizes, k", [((12, 9, 7), 10), ((3, 2, 2), 50), ((4, 0, 3), 5), ((40, 3, 1), 1)])
def test_best_and_counts_of_all(spark, sizes, k):
    rows, sides = _sides(spark, random.Random(sum(sizes)), sizes)
    passes = lambda s: (s["x"] < 8) & (s["y"] > 1)
    least = lambda s: s["x"] * 3 - s["y"]
    score = lambda ids, s: least(s) + F.length(F.concat(*ids)) % 3
    got = best_combinations(sides, ["key"] * 3, ["x", "y"], passes, least, score, k).collect()
    combos = [c for c in itertools.product(*rows) if all(r[2] is not None for r in c)]
    sums = [("__".join(r[0] for r in c), sum(r[1] for r in c), sum(r[2] for r in c)) for c in combos]
    want = sorted((x * 3 - y + len(i.replace("__", "")) % 3, i) for i, x, y in sums if x < 8 and y > 1)[:k]
    assert [(r.score, r.id) for r in got] == want
    counts = {r.status: int(r.n) for r in status_counts(sides, ["x", "y"], lambda s: F.when(passes(s), "passed").otherwise("no")).collect()}
    good = sum(x < 8 and y > 1 for _, x, y in sums)
    assert counts == {s: n for s, n in (("passed", good), ("no", len(sums) - good)) if n}


def test_globs_as_the_standard_library_matches_them(spark):
    rng = random.Random(1)
    patterns = ["a" + "".join(rng.choice(["a", "b", "*", "?", "/", ".", "[ab]", "[!a]", "[", "]", "[]a]", "[^b]", "+", "é"]) for _ in range(rng.randrange(7))) for _ in range(150)]
    patterns = [p for p in patterns if "**" not in p and not p.endswith("/")]
    paths = ["a" + "".join(rng.choice("aab/.[]+^é\n") for _ in range(rng.randrange(8))) for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", F.array(*[F.col("path").rlike(glob_regex(p)) for p in patterns]).alias("hits"))
    for r in df.collect():
        assert r.hits == [fnmatch.fnmatchcase(r.path, p) for p in patterns], r.path


def test_first_pattern_in_order_and_long_paths(spark):
    patterns = ["logs/x/*", "l*", "logs/*", "one.txt", "deep/one.txt", "deep/*a*a*a*a*b"]
    paths = ["logs/x/1", "logs/y", "lx", "one.txt", "deep/one.txt", "deep", "deep/" + "a" * 1_000_000, "deep/" + "a" * 1_000_000 + "b", "other", ""]
    got = [r.p for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string").select("i", ignored_by(F.col("path"), patterns).alias("p")).orderBy("i").collect()]
    assert got == ["logs/x/*", "l*", "l*", "one.txt", "deep/one.txt", None, None, "deep/*a*a*a*a*b", None, None]


@pytest.mark.parametrize("pattern", ["", None, "/a", "a/", "a\\b", "a/../b", "a/**", "*.pyc", "?a", "[a]b"])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(ValueError):
        checked(["fine", pattern])


def test_one_owner_each(spark):
    paths = spark.createDataFrame([("s/1", "file"), ("s/2", "file"), ("s/2", "file"), ("sx/1", "link"), ("t/.keep", "file"), ("u/1", "file"), ("u/2", "socket"), ("v", None), (None, "file")], "path string, entry string")
    owners = spark.createDataFrame([("s/2", "B"), ("s/2", "A"), ("u/2", "A"), ("sx/1", "NO SUCH")], "path string, kind string")
    ask = lambda sealed: {r.path: (r.owner, r.pattern) for r in conserve(paths, owners, ["A", "S", "B", "K"], {"s": "S"}, {".keep": "K"}, ["u/*", "s/*"], sealed).collect()}
    owned = {"s/1": ("S", None), "s/2": ("A", None), "sx/1": ("UNOWNED", None), "t/.keep": ("K", None), "u/2": ("IRREGULAR", None), "v": ("UNOWNED", None), None: ("UNOWNED", None)}
    assert ask(False) == owned | {"u/1": ("IGNORED", "u/*")}
    assert ask(True) == owned | {"u/1": ("UNOWNED", None)}
    assert {tuple(r) for r in ignore_conflicts(owners, ["u/*", "s/[2]", "q"]).collect()} == {("u/2", "u/*"), ("s/2", "s/[2]")}
    assert ignore_conflicts(owners, []).collect() == []
    assert conserve(paths.limit(0), owners, ["A"]).collect() == []
