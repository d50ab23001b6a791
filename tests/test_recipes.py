import gzip
import io
import random

from tallyspark.operators.recipes import final_artifacts, run_recipes

STEPS = "recipe string, step int, rule string, inputs array<string>, output string, separator string, mtime long, compresslevel int"


def plain(steps, sources):
    """Each recipe's steps in order, to its first fault."""
    out = {}
    for recipe in {s[0] for s in steps}:
        made, stopped = {}, False
        for _, n, rule, inputs, output, sep, mtime, level in sorted((s for s in steps if s[0] == recipe), key=lambda s: s[1]):
            if stopped:
                out[recipe, n] = ("not reached", None)
                continue
            read = [sources.get((recipe, i[8:])) if i.startswith("sources/") else made.get(i) for i in inputs or []]
            lacking = min(("missing source" if i.startswith("sources/") else "unknown input" for i, r in zip(inputs or [], read, strict=True) if r is None), default=None)
            fault = "no output" if not output else "unsupported rule" if rule not in ("concat", "gzip") else "one input expected" if rule == "gzip" and len(inputs or []) != 1 else lacking
            if fault:
                out[recipe, n], stopped = (fault, None), True
                continue
            if rule == "concat":
                made[output] = ("\n" if sep is None else sep).encode().join(read)
            else:
                to = io.BytesIO()
                with gzip.GzipFile(fileobj=to, mode="wb", mtime=mtime or 0, compresslevel=6 if level is None else level) as z:
                    z.write(read[0])
                made[output] = to.getvalue()
            out[recipe, n] = ("built", made[output])
    return out


def test_random_recipes_against_steps_in_order(spark):
    rng = random.Random(4)
    sources, steps = {}, []
    for r in range(60):
        recipe, names = f"r{r}", []
        for i in range(3):
            sources[recipe, f"s{i}"] = rng.randbytes(rng.randint(0, 20))
        for n in range(rng.randint(1, 7)):
            pool = [f"sources/s{i}" for i in range(3)] * 4 + names * 5 + ["sources/no"] * (r % 5 == 0) + ["later"] * (r % 7 == 0)
            rule = rng.choice(["concat", "concat", "gzip"] + ["tar"] * (r % 11 == 0))
            inputs = [rng.choice(pool) for _ in range(1 if rule == "gzip" and r % 13 else rng.randint(0, 4))]
            output = rng.choice(["a", "b", f"o{n}"] + [None] * (r % 17 == 0))
            steps.append((recipe, n, rule, inputs, output, rng.choice([None, "", "|", "é"]), rng.choice([None, 0, 1700000000]), rng.choice([None, 1, 9])))
            names += [output] if output else []
    steps += [("empty", 0, "concat", None, "x", None, None, None), ("itself", 0, "concat", ["x"], "x", None, None, None)]
    held = spark.createDataFrame([(r, n, bytearray(c)) for (r, n), c in sources.items()], "recipe string, name string, content binary")
    got = {(r.recipe, r.step): (r.status, None if r.content is None else bytes(r.content)) for r in run_recipes(spark.createDataFrame(steps, STEPS), held).collect()}
    assert got == plain(steps, sources)
    assert run_recipes(spark.createDataFrame([], STEPS), held).count() == 0


def test_final_artifacts(spark):
    held = spark.createDataFrame([("a", "x", bytearray(b"1"))], "recipe string, name string, content binary")
    steps = [("a", 0, "concat", ["sources/x", "sources/x"], "out", "-", None, None), ("a", 1, "gzip", ["out"], "z", None, None, None)]
    finals = spark.createDataFrame([("a", "out"), ("a", "z"), ("a", "none")], "recipe string, final string")
    got = sorted((r.status, r.digest is not None) for r in final_artifacts(spark.createDataFrame(steps, STEPS), held, finals).collect())
    assert got == [("built", True), ("built", True), ("not produced", False)]
