"""The text profile against Python's own Unicode functions, over all characters and over mixtures of those that do something."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from tallyspark.functions.text import _classes, _profile, profile


def test_every_character(spark):
    every = spark.range(sys.maxunicode + 1, numPartitions=4).where("id not between 55296 and 57343")
    # A character's UTF-8 bytes by its number.
    b = lambda *parts: F.concat(*[F.unhex(F.lpad(F.hex(p), 2, "0")) for p in parts])
    n = F.col("id")
    low = lambda k: (F.shiftright(n, 6 * k).bitwiseAND(63) + 128).cast("long")
    encoded = F.when(n < 128, b(n)).when(n < 2048, b(F.shiftright(n, 6) + 192, low(0))).when(n < 65536, b(F.shiftright(n, 12) + 224, low(1), low(0))).otherwise(b(F.shiftright(n, 18) + 240, low(2), low(1), low(0)))
    c = F.decode(encoded, "UTF-8")
    got = every.select("id", profile(F.concat(F.lit(" x"), c, F.lit("y"))).alias("p"), profile(F.concat(F.lit("e"), c), True).alias("q")).toPandas()
    assert len(got) == sys.maxunicode + 1 - 2048
    wrong = [(i, p, q) for i, p, q in zip(got["id"], got["p"], got["q"], strict=True) if p != _profile(f" x{chr(i)}y", False) or q != _profile(f"e{chr(i)}", True)]
    assert wrong == []


def test_mixtures(spark):
    rng = random.Random(3)
    *_, folds, longer = _classes()
    active = [*longer, *rng.sample(sorted(folds), 150), *" \t\n\x1c　.,!¿«„—_ßẞİıΣςa", "é", "̣́", "각", "Å", "क़"]
    texts = ["".join(rng.choices(active, k=rng.randrange(30))) for _ in range(3000)] + ["", None, "ß" * 100_000, "é" * 100_000, " " * 1_000_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", profile(F.col("t")).alias("p"), profile(F.col("t"), True).alias("q"))
    for r in rows.collect():
        assert (r.p, r.q) == (_profile(texts[r.i], False), _profile(texts[r.i], True)), texts[r.i]
    assert sum(t is not None and not unicodedata.is_normalized("NFC", t) for t in texts) > 100
