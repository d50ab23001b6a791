import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark.llm._common import write_table
from tallyspark.llm.line_dedup import FLIPS, FUZZY_CHARS, KEYS, _close, _first_shared, _grouped, all_near_enough, dedup_lines, edit_distance, edit_distances, line_keys, line_prints, near_enough, normal_lines, normalise


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(docs, percent=80):
    """(doc_id, text) after the removal, over all pairs of lines."""
    places = sorted({(d, i, f) for d, t in docs for i, line in enumerate((t or "").split("\n")) if (f := normalise(line))}, key=lambda p: (p[0], p[1]))
    forms = sorted({f for _, _, f in places})
    root = {f: f for f in forms}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    links = 0
    for i, x in enumerate(forms):
        for y in forms[:i]:
            if min(len(x.encode()), len(y.encode())) >= FUZZY_CHARS and edit_distance(x, y, most := (100 - percent) * max(len(x), len(y)) // 100) <= most:
                root[find(x)] = find(y)
                links += 1
    first, gone = {}, set()
    for d, i, f in places:
        if first.setdefault(find(f), (d, i)) != (d, i):
            gone.add((d, i))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}, links


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(60)]
    base = [" ".join(rng.choice(words, rng.integers(2, 160))) for _ in range(25)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.integers(1, 7)):
            line = str(rng.choice(base))
            if rng.random() < 0.6:
                at = int(rng.integers(0, len(line)))
                line = line[:at] + str(rng.choice(list("xyz,!7 "))) + line[at + 1 :]
            lines.append(line.upper() if rng.random() < 0.2 else line)
        docs.append((d, "\n".join(lines)))
    docs += [(60, None), (61, ""), (62, "\n\n--\n"), (63, "one\none\nOne!"), (64, base[0])]
    want, links = brute(docs)
    assert links > 3
    out = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert {r.doc_id: r.n_lines for r in out}[60] == 0
    assert {r.doc_id: r.n_removed for r in out}[63] == 2


def test_links_by_edit_similarity_alone(spark):
    """One to three words of lines of ten to forty are changed, which moves many bits of a hash of words."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), rng.integers(3, 9)))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.integers(10, 40))]
        docs.append((len(docs), " ".join(base)))
        for _ in range(2):
            near = list(base)
            for i in rng.choice(len(base), rng.integers(1, 4), replace=False):
                near[i] = word()
            docs.append((len(docs), " ".join(near)))
    lines = [t for _, t in docs]
    root = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if edit_distance(x, lines[j], max(len(x), len(lines[j])) // 5) <= max(len(x), len(lines[j])) // 5:
                old, new = sorted((root[i], root[j]), reverse=True)
                root = [new if r == old else r for r in root]
    kept = {i for i, r in enumerate(root) if i == r}
    out = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert 12 <= len(kept) < 20 and {r.doc_id for r in out if r.text} == kept


def test_other_content_of_one_normal_form_stays(spark):
    lines = ["2019: 45.2", "1987: 3.1", "Total 12", "Total 987654", "a<b", "a>>=b", "Sum of all the positions in the year 1999: 1234567890", "Sum of all the positions in the year 7: 3", "7", "8"]
    again = ["TOTAL  12.", "total 987654"]
    docs = list(enumerate([*lines, *again]))
    out = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in out] == [*lines, "", ""]


def test_normal_forms():
    assert normalise("  Über 1234,56 -- The_End! ") == "Über 0 0 the end"
    assert normalise(" .,- ") == ""
    rows, numbers, data, starts, ends = normal_lines(["a\n\nB  b", None, "", "x"])
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"a", b"b b", b"x"]
    assert rows.tolist() == [0, 0, 3] and numbers.tolist() == [0, 2, 0]


def test_edges(spark):
    kinds = "doc_id long, n_lines string, text string, _gone int"
    assert dedup_lines(spark.createDataFrame([], kinds)).count() == 0
    rows = [(1, "a", "same line here", 1), (1, "a", "same line here", 1), (None, "b", "same line here", 2), (2, "c", None, 3)]
    out = dedup_lines(spark.createDataFrame(rows, kinds))
    assert out.columns == ["doc_id", "n_lines", "text", "_gone", "n_lines_", "n_removed"]
    got = sorted((str(r.doc_id), r.text, r["n_lines"]) for r in out.collect())
    assert got == sorted([("1", "same line here", "a"), ("1", "same line here", "a"), ("None", "", "b"), ("2", None, "c")], key=str)


def test_long_lines_link(spark):
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(900))
    rows = [(1, text), (2, text[:3000] + "zz" + text[3002:])]
    assert [r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [text, ""]


@pytest.mark.parametrize("seed", range(4))
def test_edit_distance(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        a = "".join(rng.choice(list("abc"), rng.integers(0, 14)))
        b = "".join(rng.choice(list("abc"), rng.integers(0, 14)))
        most = int(rng.integers(0, 9))
        assert edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)
        b = a[:most] + b[:1] + a[most:]
        assert near_enough(a, b, 80) == (5 * levenshtein(a, b) <= max(len(a), len(b)))


def test_lines_beyond_the_table_of_words_are_decided_alike(monkeypatch):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(120)]
    lines = [" ".join(base), " ".join(base[:60] + ["zzzzz"] * 8 + base[68:]), " ".join(base[60:] + base[:60])]
    decided = [near_enough(x, y, 80) for x in lines for y in lines]
    monkeypatch.setattr("tallyspark.llm.line_dedup.WORD_TABLE", 100)
    assert [near_enough(x, y, 80) for x in lines for y in lines] == decided == [True, True, False, True, True, False, False, False, True]


def test_recall_on_the_table_against_edit_similarity_alone():
    """Of all pairs of lines of the smallest table with edit similarity 0.8, those that share a key and pass the screen."""
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    forms = sorted({f for t in texts for line in (t or "").split("\n") if len((f := normalise(line)).encode()) >= FUZZY_CHARS and len(f) < 3000})
    grams = np.zeros((len(forms), 4096), np.uint8)
    for i, f in enumerate(forms):
        at, held = np.unique([zlib.crc32(f[k : k + 3].encode()) % 4096 for k in range(len(f) - 2)], return_counts=True)
        grams[i, at] = np.minimum(held, 255)
    sizes, pairs = np.array([len(f) for f in forms]), []
    for i in range(len(forms)):
        most = np.maximum(sizes[:i], sizes[i]) // 5
        # An edit takes three trigrams at most.
        may = (np.minimum(grams[:i], grams[i]).sum(1) >= np.maximum(sizes[:i], sizes[i]) - 2 - 3 * most) & (np.abs(sizes[:i] - sizes[i]) <= most)
        pairs += [(j, i) for j in np.flatnonzero(may) if edit_distance(forms[i], forms[j], int(most[j])) <= most[j]]
    a, b = np.array(pairs).T
    lines = normal_lines(["\n".join(forms)])[2:]
    keys, prints = line_keys(*lines), line_prints(*lines)
    flips = sum(np.bitwise_count(p[a] ^ p[b]).astype(int) for p in prints)
    found = (keys[a] == keys[b]).any(axis=1) & (flips <= FLIPS)
    assert len(pairs) > 20 and found.mean() >= 0.9
    print(len(pairs), found.mean())


def test_extra_columns_named_like_internal_ones(spark):
    rows = [(1, "the same line here", 1, 2, 3, 4), (2, "the same line here", 5, 6, 7, 8)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, _d int, _v int, _version int, first int"))
    assert out.columns == ["doc_id", "text", "_d", "_v", "_version", "first", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "the same line here", 1, 2, 3, 4, 1, 0), (2, "", 5, 6, 7, 8, 1, 1)]


def test_crowds_lose_no_link(spark):
    """Hundreds of lines of one template are one group, beside as many that only share a passage of half their length and stay."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    template = " ".join(word() for _ in range(14))
    passage = " ".join(word() for _ in range(9))
    lines = [f"{template} {word()}" for _ in range(300)] + [f"{passage} {' '.join(word() for _ in range(9))}" for _ in range(120)]
    docs = [(i, lines[j]) for i, j in enumerate(rng.permutation(len(lines)))]
    want, _ = brute(docs)
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and sum(t.startswith(template) for t in got.values()) == 1 and sum(t.startswith(passage) for t in got.values()) == 120


def test_a_pair_is_given_by_its_first_shared_key_only(spark):
    rng = np.random.default_rng(2)
    held = rng.integers(-(1 << 31), 1 << 31, (12, len(KEYS)))
    held[1:][rng.random((11, len(KEYS))) < 0.6] = 0
    held[0], held[1] = -(1 << 31), (1 << 31) - 1
    held[2, -1] = -(1 << 31)
    lines = spark.createDataFrame([(i, [int(k) for k in row]) for i, row in enumerate(held)], "node long, held array<long>")
    named = [F.col("held")[i].cast("int").alias(k) for i, k in enumerate(KEYS)]
    x, y = (lines.select(F.posexplode("held").alias("band", "at"), "node", *named).select((F.shiftleft(F.col("band").cast("long"), 32) + F.col("at")).alias("key"), F.col("node").alias(f"node_{s}"), *[F.col(k).alias(f"{k}_{s}") for k in KEYS]) for s in "xy")
    met = x.join(y, (x["key"] == y["key"]) & (F.col("node_x") > F.col("node_y")))
    got = [(r.node_x, r.node_y) for r in met.where(_first_shared(x["key"], "x", "y")).select("node_x", "node_y").collect()]
    want = [(i, j) for i in range(12) for j in range(i) if (held[i] == held[j]).any()]
    assert sorted(got) == want and met.count() > 2 * len(want)


def test_lines_meet_in_the_group_of_one(spark):
    """A line's form stands once in each part of its group, not beside each of the lines compared with it."""
    forms = [(i, f"the line that all of the others are compared with {i % 7}" if i % 3 else f"another one altogether, number {i}") for i in range(1, 400)]
    pairs = write_table(spark.createDataFrame([(i, 1) for i in range(2, 400)], "a long, b long"))
    groups = _grouped(pairs, spark.createDataFrame(forms, "node long, form string"))
    assert groups.count() < 398 + 8
    found = groups.mapInArrow(lambda it: _close(it, 80), "a long, b long").collect()
    assert sorted((r.a, r.b) for r in found) == [(i, 1) for i in range(2, 400) if i % 3]


@pytest.mark.parametrize("seed", range(3))
def test_distances_to_many_at_once(seed):
    rng = np.random.default_rng(seed)
    for longest in (3, 20, 80):
        draw = lambda n: "".join(rng.choice(list("abcé𝄞\0"), rng.integers(0, n)))
        a = draw(longest)
        others = [*(draw(longest) for _ in range(9)), "", a, a + "x"]
        assert edit_distances(a, others).tolist() == [levenshtein(a, b) for b in others]
        assert all_near_enough(a, others, 80).tolist() == [near_enough(a, b, 80) for b in others]


def test_lines_of_a_crowd_meet_in_blocks(spark, monkeypatch):
    """Lines that share a passage of two thirds and link by chance: the links are those of all pairs as rows, but such rows are not made."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = " ".join(word() for _ in range(20))
    lines = spark.createDataFrame([(i, f"{' '.join(word() for _ in range(rng.integers(6, 12)))} {passage}") for i in range(150)], "doc_id long, text string")
    monkeypatch.setattr("tallyspark.llm.line_dedup.BLOCK", 40)
    made, rows, left = _grouped, [], []
    monkeypatch.setattr("tallyspark.llm.line_dedup._grouped", lambda pairs, forms: rows.append(pairs.count) or made(pairs, forms))
    for crowd in (64, 1000):
        monkeypatch.setattr("tallyspark.llm.line_dedup.CROWD", crowd)
        rows.append(0)
        left.append({r.doc_id for r in dedup_lines(lines).collect() if r.text})
    before = rows.index(0, 1)
    assert left[0] == left[1] and 1 < len(left[0]) < 150
    assert 3 * sum(rows[:before]) < sum(rows[before:])
