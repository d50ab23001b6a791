import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm.packing import Capacities, best_fit_packing, encode, plan, spans

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def brute(sizes, room):
    """Best-fit decreasing, one piece at a time over a plain list of bins."""
    left = []
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= size]
        if fits:
            left[min(fits)[1]] -= size
        else:
            left.append(room - size)
    return left


def filled(counts, room):
    bins = {}
    for size, first, last, start, per, base in plan(counts, room):
        for j in range(first, last):
            bins.setdefault(start + (j - first) // per, []).append((base + (j - first) % per * size, size))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    room = int(rng.integers(5, 70))
    sizes = rng.integers(1, room + 1, rng.integers(1, 400)).tolist()
    counts = {s: sizes.count(s) for s in set(sizes)}
    bins = filled(counts, room)
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= room
    assert sorted(s for p in bins.values() for _, s in p) == sorted(sizes)
    assert sorted(room - sum(s for _, s in p) for p in bins.values()) == sorted(brute(sizes, room))


def test_plan_does_not_grow_with_the_number_of_pieces():
    counts = {s: 1 + s % 7 for s in range(1, 200)}
    assert len(plan({s: n * 10**9 for s, n in counts.items()}, 256)) < 3 * len(plan({s: n * 10**3 for s, n in counts.items()}, 256))


def test_tightest():
    tree = Capacities(20)
    for c in (3, 9, 17):
        tree.put(c, 0, 1)
    assert [tree.tightest(s) for s in (1, 3, 4, 9, 10, 17, 18)] == [3, 3, 9, 9, 17, 17, None]
    tree.take(9, 1)
    assert tree.tightest(4) == 17


def test_spans():
    assert spans(5, 4) == [(0, 1), (1, 5)]
    assert spans(8, 4) == [(0, 4), (4, 8)] and spans(3, 4) == [(0, 3)] and spans(0, 4) == []


def test_ids_are_the_tokenizers(spark):
    plain = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").toPandas().text.tolist()
    docs += ["", " ", "a<|endoftext|>b", "it's  naïve\t\n\n 1234 !!??", "日本語 テキスト", "x" * 3000, "   ", "   x", "🙂🙂 é́", "a\x00b"]
    for text in docs:
        assert encode(text, VOCABULARY).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


def test_whole_table(spark):
    rows = [(i, "word " * (i * 7 % 190)) for i in range(60)] + [(60, None), (61, ""), (7, "again"), (7, "again"), (None, "no id")]
    room = 64
    out = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, room=room, with_ids=True).toPandas()
    total = sum(len(encode(t, VOCABULARY)) for _, t in rows)
    assert out.length.sum() == total and out.length.max() <= room
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= room
    assert out.sequence_id.nunique() == len(brute(out.length.tolist(), room))
    for r in out.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    whole = {i: t for i, t in rows if i is not None and i != 7}
    for doc, part in out.dropna(subset=["doc_id"]).groupby("doc_id"):
        if doc in whole:
            assert np.concatenate(part.sort_values("piece").ids.tolist()).tolist() == encode(whole[doc], VOCABULARY).tolist()
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
