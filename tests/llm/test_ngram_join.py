import random

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm._common import NON_SPACE, shingle_hashes, steps, word_hashes, word_spans, write_table
from tallyspark.llm._graph import components
from tallyspark.llm.ngram_join import _asked_sets, _linked, _screened, overlap, parity_map, shingle_sets, similar_sets


def plain_set(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def brute(rows, n, percent):
    sets = [plain_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)]


def test_links_of_very_long_sets_at_the_limit():
    """A million words on each side, the intersection just at and just below what links."""
    centre = np.arange(1_000_000, dtype=np.uint64) << np.uint64(20)
    need = overlap(1_000_000, 1_000_000, 90)
    at, below = (np.sort(np.concatenate([centre[:k], centre[k:] + np.uint64(1)])) for k in (need, need - 1))
    batch = pa.RecordBatch.from_pydict({"centre": [7] * 3, "part": [0] * 3, "node": [None, 1, 2], "shingles": [x.tobytes() for x in (centre, at, below)]})
    assert [b.to_pylist() for b in _linked(iter([batch]), percent=90)] == [[{"a": 1, "b": 7}]]


def test_a_long_text_at_the_limit(spark):
    """Texts of 300,000 words, one linked and one just not."""
    words = [f"w{i}" for i in range(300_000)]
    need = overlap(len(words), len(words), 80)
    texts = [" ".join([*words[:k], *[f"x{k}.{i}" for i in range(len(words) - k)]]) for k in (len(words), need, need - 1)]
    out = similar_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=1, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in out)[:2] == [(0, 0), (1, 0)]
    assert brute([(i, t) for i, t in enumerate(texts)], 1, 80) == sorted((r.doc_id, r.n_shingles, r.component_id) for r in out)


def test_null_ids_and_reused_ids(spark):
    """Texts without an id or with one id are told apart by their hash."""
    rows = [(None, f"t{i} a b c d e f g") for i in range(30)] + [(1, "p q r s t u v w x y"), (1, "p q r s t u v w x z"), (2, "p q r s t u v w x y z")]
    out = similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), n=1, percent=80).collect()
    assert {r.component_id for r in out if r.doc_id} == {1} and all(r.component_id is None for r in out if r.doc_id is None) and len(out) == 33


def _corpus(seed, copies=40, edits=7):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(200)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    shared = [rng.choice(words) for _ in range(14)]
    out = []
    for b in base:
        for _ in range(rng.choice([1, 2, 6, copies])):
            w = list(b)
            for _ in range(rng.randint(0, edits)):
                if not w:
                    break
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(words)], [w[at], "x"]])
            if rng.random() < 0.3:
                w += shared
            out.append(" ".join(w).upper() if rng.random() < 0.1 else "  ".join(w))
    out += [None, "", " \t", out[0], out[0], "a", "A", "a b"]
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_against_all_pairs(spark, seed, n, percent):
    rows = _corpus(seed)
    out = similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=n, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(brute(rows, n, percent))


def test_edges(spark):
    kinds = "doc_id long, text string, digest int"
    assert similar_sets(spark.createDataFrame([], kinds)).count() == 0
    rows = [(5, "one two three four five six", 1), (5, "one two three four five six", 1), (None, "one two three four five six", 2), (3, None, 3), (3, "", 3)]
    out = similar_sets(spark.createDataFrame(rows, kinds)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in out) == ["(3, 0, 3)", "(3, 0, 3)", "(5, 2, 5)", "(5, 2, 5)", "(None, 2, 5)"]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 180), rng.randrange(100, 180)) for _ in range(60)] + [(7, 7)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    found = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).rows.collect()}
    assert found == {n: c for n, c in root.items() if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).count == 0


def test_hashes_follow_words_alone():
    texts = ["Foo bar  baz", "xx foo BAR\tbaz yy", "é É foo", None, "", "foo"]
    array = pa.array(texts).slice(0)
    hashes = []
    for _, _, data, offsets in steps(array, limit=14):
        starts, ends, first = word_spans(data, offsets, NON_SPACE)
        words = word_hashes(data, starts, ends)
        hashes += [words[first[i] : first[i + 1]].tolist() for i in range(len(offsets) - 1)]
    assert hashes[0] == hashes[1][1:4] and hashes[2][0] != hashes[2][1] and hashes[2][2] == hashes[5][0] == hashes[0][0]
    assert hashes[3] == hashes[4] == []
    sliced = list(shingle_sets(pa.array(["skip", *texts]).slice(1), 3))
    assert [s.tolist() for s in sliced] == [s.tolist() for s in shingle_sets(array, 3)]
    assert len(shingle_hashes(np.arange(5, dtype=np.uint64), 3)) == 3


def test_overlap():
    for a in range(1, 40):
        for b in range(1, 40):
            least = next(i for i in range(100) if 100 * i >= 90 * (a + b - i))
            assert overlap(a, b, 90) == least


def test_whole_maps_screen_large_sets_and_lose_no_link(spark):
    """Sets of thousands of shingles: 256 cells cannot tell them apart, as many cells as shingles can; also between maps of unlike width."""
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    sets = [np.unique(x) for x in (tokens[:4000], np.append(tokens[:3900], tokens[4000:4100]), tokens[:4200], tokens[:3600], np.append(tokens[:3000], tokens[4000:5000]), tokens[4000:8100], tokens[:300], tokens[:255])]
    nodes = spark.createDataFrame([(i, len(x), parity_map(x).tolist()) for i, x in enumerate(sets)], "node long, size long, map array<long>")
    assert {len(parity_map(x)) for x in sets} == {64, 128, 8, 4}
    pairs = write_table(spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i)], "a long, b long"))
    left = {(r.a, r.b) for r in _screened(pairs, nodes, 90).collect()}
    link = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
    assert {(1, 0), (2, 0), (3, 0)} <= link <= left and not {(4, 0), (4, 1), (5, 0), (5, 1), (5, 2)} & left


def test_asked_sets_come_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr("tallyspark.llm.ngram_join.HANDED_ON", 100)
    kind = pa.list_(pa.struct([("centre", pa.int64()), ("part", pa.int32()), ("node", pa.int64())]))
    asks = [[{"centre": c, "part": 0, "node": None if c == k else k} for c in range(n)] for k, n in enumerate((9, 1, 3))]
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d", "", "a b"]), pa.array(asks, kind)], ["text", "asks"])
    out = list(_asked_sets(iter([batch]), 1))
    sets = [x.tobytes() for x in shingle_sets(batch["text"], 1)]
    assert len(out) > 1 and max(b.nbytes for b in out) < 400
    assert [r for b in out for r in b.to_pylist()] == [ask | {"shingles": sets[k]} for k, part in enumerate(asks) for ask in part]
