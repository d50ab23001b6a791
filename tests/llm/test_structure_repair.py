import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.structure_repair import BLOCK_ROWS, END, damage, repair, repaired_messages, solve

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip("\t\n\x0b\x0c\r ")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Every sequence of edits with at most one insertion before each row and two behind the last; the least of (cost, audit)."""
    rows, found = ordered(rows), faults(ordered(rows))
    choices = []
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        extra = 5 if fault == "truncated" else 0
        way = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            way += [("K", extra, (role, text)), ("R", 1 + extra, ("user", text)), ("R", 1 + extra, ("assistant", text))]
        inserts = [("", 0, ()), ("I", 5, (("user", ""),)), ("I", 5, (("assistant", ""),))]
        choices.append([(i + e, a + c, (*m, *([t] if t else []))) for (i, a, m), (e, c, t) in itertools.product(inserts, way)])
    choices.append([("I" * n, 5 * n, m) for n in range(3) for m in itertools.product([("user", ""), ("assistant", "")], repeat=n)])
    best = None
    for picked in itertools.product(*choices):
        story = [t for _, _, m in picked for t in m]
        if LEGAL.fullmatch("".join(role[:1] for role, _ in story) if all(role for role, _ in story) else "?"):
            it = (sum(c for _, c, _ in picked), "".join(e for e, _, _ in picked), story)
            best = it if best is None or it[:2] < best[:2] else best
    return best


def whole(rows):
    rows = ordered(rows)
    found = faults(rows)
    turns = {t for _, t, _, _ in rows if t is not None}
    cost, audit, story = brute(rows)
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in story).encode()).hexdigest())


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", "  \n", "Well? ", "Yes.", None]
    out = []
    for conv in range(n):
        for i in range(rng.randint(1, longest)):
            out.append((conv if conv else None, rng.choice([i, i, i + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return out


def test_against_every_sequence_of_edits(spark):
    rows = conversations(3, 60, 4)
    got = {r.conv_id: tuple(r)[1:] for r in repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((conv, turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: whole(r) for conv, r in by_conv.items()}


def test_damage(spark):
    rows = conversations(5, 80, 6)
    got = damage(spark.createDataFrame(rows, SCHEMA)).collect()
    spread = [tuple(r)[:4] for r in got for _ in range(r.copies)]
    assert sorted(map(repr, spread)) == sorted(map(repr, plain_damage(rows)))
    assert {r.conv_id for r in got} == {r[0] for r in rows}


def test_one_conversation_over_many_blocks_and_tasks(spark):
    """The same letters as one solution of the whole conversation; its messages join to the digest."""
    rng = random.Random(1)
    n = 9 * BLOCK_ROWS
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), f"line {i}" + rng.choice([".", ".", ""])) for i in range(n)]
    rows += [(7, 3, "user", "again.")] * 400 + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.conv_id: r for r in repair(df).collect()}
    line = ordered([r for r in rows if r[0] == 7])
    modes = {"": 0, "truncated": 1}
    cost, audit = solve([(r[2][:1], modes.get(f, 2), 1) for r, f in zip(line, faults(line), strict=True)], list(END))[0]
    assert (got[7].cost, got[7].audit) == (cost, audit)
    assert got[7].duplicate == 399 and (got[8].cost, got[8].audit) == (0, "KK")
    messages = sorted((r.position, r.role, r.text) for r in repaired_messages(df).where("conv_id = 7").collect())
    assert [p for p, _, _ in messages] == list(range(len(messages)))
    assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in messages).encode()).hexdigest() == got[7].repaired_sha256
    assert LEGAL.fullmatch("".join(r[:1] for _, r, _ in messages))


def test_nothing_left_empty_tables_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x.", 0), (2, None, None, None, 1)], SCHEMA + ", copies int").withColumn("mode", F.lit("m")).withColumn("part", F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in repair(rows).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == {1: (0, 0, 0, 0, 0, 0, "", nothing), 2: (0, 1, 0, 0, 0, 2, "D", nothing)}
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 5_000_000 + "."), (1, 1, "assistant", "y " * 1_000_000), (1, 2, "assistant", "z.")]
    (got,) = repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (got.cost, got.audit, got.truncated) == (2, "KDK", 1)


@pytest.mark.parametrize("letters", ["", "I"])
def test_shorter_audits_come_first(letters):
    """Ends of equal cost: the one whose letters end first is the smaller integer."""
    assert solve([], [(5, "I"), (5, letters), (5, ""), (5, "R")]) == [(5, "I"), (5, letters), (5, ""), (5, "R")]
