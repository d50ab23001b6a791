import re

import numpy as np
import pytest

from tallyspark.llm.decontamination import compile_items, decontaminate, merged, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n):
    wanted = []
    for item, text in items:
        w = plain_words(text)
        k = min(n, len(w))
        wanted += [(str(item), w[i : i + k]) for i in range(len(w) - k + 1) if k]
    out = []
    for text in docs:
        w, hit, held = plain_words(text), set(), set()
        for item, win in wanted:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    held.add(item)
        out.append((len(w), hit, sorted(held)))
    return out


def test_words():
    for text in ("Ab-c_1é  Ñ`x{y}\x7fz\x00q", "", "   ", "日本 語", None, "A" * 5000):
        assert [w.decode() for w in words(text)] == plain_words(text)


@pytest.mark.parametrize("seed", range(3))
def test_against_every_place(spark, seed):
    rng = np.random.default_rng(seed)
    vocabulary = list("abcde") + ["É", "ß2"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(rng.integers(1, 9))) for i in range(8)] + [(8, None), (9, " - "), (1, text(3)), (10, "A b"), (11, "c")]
    docs = [text(rng.integers(0, 40)) for _ in range(40)] + [None, "", "c", text(3000), items[0][1].upper() + ", x"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 24, 200):
        out = {r.doc_id: r for r in decontaminate(frame, bench, window=4, block_bytes=block).collect()}
        for i, (n, hit, held) in enumerate(brute(docs, items, 4)):
            got = out[i]
            assert got.n_words == n and got.hit_items == held
            assert {p for s in got.hit_spans for p in range(s.first, s.last)} == hit


def test_shifts_skip_and_find():
    (tables,) = compile_items([("x", "a b c d e")], 5)
    assert list(tables.search([b"z"] * 50 + [b"a", b"b", b"c", b"d", b"e"])) == [(50, {"x"})]
    assert tables.shift[b"a", b"b"] == 3 and (b"z", b"z") not in tables.shift


def test_merged():
    assert merged([(5, 7), (0, 2), (2, 3), (6, 9)]) == [(0, 3), (5, 9)] and merged([]) == []


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, n_words string")
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate(docs, none)
    assert out.columns == ["doc_id", "text", "n_words", "hit_spans", "hit_items", "n_words_"]
    assert [r.n_words_ for r in out.orderBy("doc_id").collect()] == [0, 2, 2]
    assert decontaminate(docs.limit(0), none).count() == 0
