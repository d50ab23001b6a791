"""Conversation structure repair: the cheapest edits that give roles (s?(ua)+)?, by integer minima over a DAG.

Equal rows of a conversation are counted first, then all rows are dealt by
ranges of (conversation, turn, role, text), so that one conversation of any
length spreads over tasks. A task cuts its conversations into blocks. A
conversation that lies whole within one block is solved there. The others
pass a chain of small relations: costs of each block from state to state,
the cost still to pay behind each block, then each block's own letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm._common import write_table

#: What counts as space at the end of a text, and what may end one.
SPACES, ENDS = "\t\n\x0b\x0c\r ", ".!?"
#: Costs of the edits; an insertion writes an empty text.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: Letters of the audit by their digit, so that integers order audits as ASCII does; 0 pads the end.
LETTERS = {1: "D", 2: "I", 3: "K", 4: "R"}
_AUDIT = str.maketrans({str(k): v for k, v in LETTERS.items()})
#: States of the roles written so far: none, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a rerole or an insertion leads, and the roles they write.
NEXT, WRITES = (USER, USER, ASSISTANT, USER), {USER: "user", ASSISTANT: "assistant"}
#: Where keeping a role of this initial leads from a state.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What is left to pay in each state when a conversation ends, with the letters for it.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: Rows and bytes of text of one block; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 20
#: A character prefix that ranges are cut by; rows alike in it share a task.
PREFIX = 256

OK, TRUNCATED, GONE = range(3)
_BITS = 3
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_UNREACHED = 1 << 60


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32 of `conv_id:turn` modulo 20; a null counts as one space.

    0 drops a row (one row of nulls per conversation stays, so that its id
    does), 1 empties the text, 2 takes the sentence ends out of it, 3 writes
    the row twice, 4 sets the role to user. Adds `copies`.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(space("text"), ENDS, "")).otherwise(space("text"))
    kept = lambda c: F.when(fault != 0, c)
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", kept(F.col("turn")).alias("turn"), kept(F.when(fault == 4, "user").otherwise(space("role"))).alias("role"), kept(text).alias("text"), copies.cast("long").alias("copies"))


def _classed(rows: DataFrame) -> DataFrame:
    """Distinct rows with how many of each there are, and what the first of them is: 0 sound, 1 truncated, 2 to be deleted."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    digest = F.sha2(F.col("text"), 256)
    again = counted.where("copies > 0").groupBy("conv_id", "role", digest.alias("digest"))
    again = again.agg(F.count(F.lit(1)).alias("turns"), F.bool_or(F.col("turn").isNull()).alias("timeless"), F.min("turn").alias("first")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "timeless", "first")
    joined = counted.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (digest == F.col("_d")), "left")
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = F.length(bare) == 0
    later = F.coalesce(F.when(F.col("timeless"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), F.lit(False))
    sound = F.right(bare, F.lit(1)).isin(*ENDS)
    mode = F.when(blank | later, GONE).when(sound, OK).otherwise(TRUNCATED)
    return joined.select("conv_id", "turn", "role", "text", "copies", mode.cast("int").alias("mode"), blank.alias("blank"))


class _Block:
    """Consecutive rows of one conversation, with what its neighbours need to know of it."""

    def __init__(self) -> None:
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.modes: list[int] = []
        self.copies: list[int] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.turns, self.first_turn, self.last_turn, self.size = 0, None, None, 0

    def add(self, turn, role: str | None, text: str | None, copies: int, mode: int, blank: bool) -> None:
        if not copies:
            return
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        kind = role[:1]
        self.counts["illegal"] += (bool(self.roles) and not _legal(self.roles[-1][:1], kind)) + (copies - 1)
        if blank:
            self.counts["blank"] += copies
        else:
            self.counts["duplicate"] += copies - (mode != GONE)
            self.counts["truncated"] += mode == TRUNCATED
        self.roles.append(role)
        self.texts.append(text)
        self.modes.append(mode)
        self.copies.append(copies)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.roles) >= BLOCK_ROWS or self.size >= BLOCK_BYTES

    def nodes(self) -> list[tuple[str, int, int]]:
        """Rows as (initial, mode, copies); copies behind a kept one are a node of their own, as all of them go."""
        out = []
        for role, mode, copies in zip(self.roles, self.modes, self.copies, strict=True):
            if mode == GONE:
                out.append((role[:1], GONE, copies))
            else:
                out.append((role[:1], mode, 1))
                if copies > 1:
                    out.append((role[:1], GONE, copies - 1))
        return out


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _edges(state: int, kind: str, mode: int, copies: int) -> Iterator[tuple[str, int, int]]:
    """(digits, cost, state after) of every way past a row. An insertion before a deletion never is least: behind it, it reads less."""
    yield "1", DELETE * copies, state
    if mode == GONE:
        return
    extra = LEFT_TRUNCATED if mode == TRUNCATED else 0
    for digits, paid, at in (("", 0, state), ("2", INSERT, NEXT[state])):
        if at in KEEP.get(kind, ()):
            yield digits + "3", paid + extra, KEEP[kind][at]
        yield digits + "4", paid + extra + REROLE, NEXT[at]


_EDGES = {(s, k, m): [e for e in _edges(s, k, m, 1)] for s in range(4) for k in ("s", "u", "a", "") for m in (OK, TRUNCATED)}


def _ways(state: int, kind: str, mode: int, copies: int) -> list[tuple[str, int, int]]:
    return [("1", DELETE * copies, state)] if mode == GONE else _EDGES[state, kind if kind in KEEP else "", mode]


def solve(nodes: list[tuple[str, int, int]], ends: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """For each state before the nodes, the least cost and its least letters, given (cost, letters) of each state behind them.

    A weight is one integer: the cost in its high digits, then a fixed width
    of digits for the letters from the first one on, zeros at the end. An
    edge in front moves the letters one place down. Integers compare as
    (cost, letters) do, so the least integer decides everything.
    """
    width = _BITS * (2 * len(nodes) + 3)
    mask = (1 << width) - 1
    back = {v: k for k, v in LETTERS.items()}
    weights = [(cost << width) | sum(back[c] << (width - _BITS * (i + 1)) for i, c in enumerate(letters)) for cost, letters in ends]
    for kind, mode, copies in reversed(nodes):
        new = []
        for state in range(4):
            best = None
            for digits, cost, to in _ways(state, kind, mode, copies):
                w = weights[to]
                shift = _BITS * len(digits)
                w = (((w >> width) + cost) << width) | (int(digits, 8) << (width - shift)) | ((w & mask) >> shift)
                best = w if best is None or w < best else best
            new.append(best)
        weights = new
    return [(w >> width, f"{w & mask:o}".zfill(width // _BITS).rstrip("0").translate(_AUDIT)) for w in weights]


def _costs(nodes: list[tuple[str, int, int]]) -> list[int]:
    """Least costs from each state before the nodes to each state behind them, 16 in a row."""
    out = [[0] * 4 for _ in range(4)]
    for end in range(4):
        costs = [0 if s == end else _UNREACHED for s in range(4)]
        for kind, mode, copies in reversed(nodes):
            costs = [min(cost + costs[to] for _, cost, to in _ways(s, kind, mode, copies)) for s in range(4)]
        for s in range(4):
            out[s][end] = costs[s]
    return [min(c, _UNREACHED) for row in out for c in row]


class _Story:
    """A conversation written block by block: its digest, audit and counts, without its texts."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.sha, self.written = conv, START, hashlib.sha256(), 0
        self.audit: list[str] = []
        self.cost, self.counts = 0, dict.fromkeys(_COUNTS, 0)
        self.turns, self.first_turn, self.last_turn, self.last_kind = 0, None, None, None

    def take(self, block: _Block, letters: str) -> list[tuple[str, str, str]]:
        """Writes a block by its letters; gives the (edit, role, text) written."""
        out, at, rows = [], 0, zip(block.roles, block.texts, block.modes, block.copies, strict=True)

        def write(edit: str, role: str, text: str) -> None:
            self.sha.update((("\n" if self.written else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.written += 1
            out.append((edit, role, text))

        def insert() -> None:
            self.state, self.cost = NEXT[self.state], self.cost + INSERT
            self.audit.append("I")
            write("I", WRITES[self.state], "")

        for role, text, mode, copies in rows:
            gone = copies
            if mode != GONE:
                gone -= 1
                if letters[at] == "I":
                    insert()
                    at += 1
                self.audit.append(letters[at])
                if letters[at] == "D":
                    self.cost += DELETE
                else:
                    self.cost += LEFT_TRUNCATED * (mode == TRUNCATED) + REROLE * (letters[at] == "R")
                    self.state = KEEP[role[:1]][self.state] if letters[at] == "K" else NEXT[self.state]
                    write(letters[at], role if letters[at] == "K" else WRITES[self.state], text)
                at += 1
            if gone:
                self.audit.append("D" * gone)
                self.cost += DELETE * gone
                at += 1
        for _ in letters[at:]:
            insert()
        if block.roles:
            self.counts["illegal"] += self.last_kind is not None and not _legal(self.last_kind, block.roles[0][:1])
            self.last_kind = block.roles[-1][:1]
        for name, n in block.counts.items():
            self.counts[name] += n
        if block.first_turn is not None:
            self.turns += block.turns - (self.last_turn == block.first_turn)
            self.first_turn = block.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = block.last_turn
        return out

    def digest(self) -> dict:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_MESSAGES = "messages array<struct<edit string, role string, text string>>"
_BLOCK = "roles array<string>, texts array<string>, modes array<int>, copies array<long>, counts array<long>, turns long, first_turn long, last_turn long"


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _out(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{name: r.get(name) for name in schema.names} for r in rows], schema)


def _packed(block: _Block) -> dict:
    return {"roles": block.roles, "texts": block.texts, "modes": block.modes, "copies": block.copies, "counts": [block.counts[c] for c in _COUNTS], "turns": block.turns, "first_turn": block.first_turn, "last_turn": block.last_turn}


def _unpacked(row: dict) -> _Block:
    block = _Block()
    block.roles, block.texts, block.modes, block.copies = (row.get(k) or [] for k in ("roles", "texts", "modes", "copies"))
    block.counts = dict(zip(_COUNTS, row.get("counts") or [0] * 4, strict=True))
    block.turns, block.first_turn, block.last_turn = row.get("turns"), row.get("first_turn"), row.get("last_turn")
    return block


def _cut(schema: pa.Schema, with_messages: bool):
    """Rows in order to whole conversations' results, and blocks of conversations that may go on beyond this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, conv, block, split, seen = TaskContext.get().partitionId(), 0, None, None, True, False
        ready: list[dict] = []
        size = 0

        def piece() -> dict:
            nonlocal seq
            seq += 1
            return {"conv_id": conv, "whole": False, "part": part, "seq": seq, **_packed(block)}

        def whole() -> dict:
            story = _Story(conv)
            written = story.take(block, solve(block.nodes(), list(END))[START][1])
            out = {"whole": True, **story.digest()}
            if with_messages:
                out["messages"] = [{"edit": e, "role": r, "text": t} for e, r, t in written]
            return out

        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "mode", "blank")], strict=True):
                if not seen or r[0] != conv:
                    if seen:
                        ready.append(piece() if split else whole())
                        size += block.size
                    # The first conversation of a task may have begun in the one before.
                    split, seen, conv, block = not seen, True, r[0], _Block()
                elif block.full():
                    ready.append(piece())
                    size += block.size
                    split, block = True, _Block()
                block.add(*r[1:])
                if len(ready) >= 1000 or size >= 8 * BLOCK_BYTES:
                    yield _out(ready, schema)
                    ready, size = [], 0
        if seen:
            ready.append(piece())
        if ready:
            yield _out(ready, schema)

    return run


def _block_costs(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            yield _out([{**{k: r[k] for k in ("conv_id", "part", "seq")}, "costs": _costs(_unpacked(r).nodes())} for r in _by_row(batch)], schema)

    return run


def _by_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, so that only one block's texts are Python strings."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _still_to_pay(schema: pa.Schema):
    """Blocks of each conversation from its last to its first: the costs behind each, by state."""

    def run(batches):
        conv, behind, seen = None, None, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                last = not seen or r["conv_id"] != conv
                if last:
                    conv, seen, behind = r["conv_id"], True, [c for c, _ in END]
                out.append({"part": r["part"], "seq": r["seq"], "last": last, "behind": behind})
                behind = [min(r["costs"][4 * s + e] + behind[e] for e in range(4)) for s in range(4)]
            yield _out(out, schema)

    return run


def _letters(schema: pa.Schema):
    """Each block's letters from each state before it.

    Without the insertions behind the last row, no letters of a block are the
    begin of others from the same state, so the block alone decides which
    read least; what is behind it counts by its cost.
    """

    def run(batches):
        for batch in batches:
            for r in _by_row(batch):
                ends = list(END) if r["last"] else [(c, "") for c in r["behind"]]
                r["letters"] = [letters for _, letters in solve(_unpacked(r).nodes(), ends)]
                yield _out([r], schema)

    return run


def _finish(schema: pa.Schema, with_messages: bool):
    """Blocks of each conversation in order to its result; texts pass through the digest one block at a time."""

    def run(batches):
        story = None
        for batch in batches:
            for r in _by_row(batch):
                if story is None or story.conv != r["conv_id"]:
                    if story is not None and not with_messages:
                        yield _out([story.digest()], schema)
                    story = _Story(r["conv_id"])
                written = story.take(_unpacked(r), r["letters"][story.state])
                if with_messages:
                    yield _out([{"conv_id": story.conv, "part": r["part"], "seq": r["seq"], "messages": [{"edit": e, "role": a, "text": t} for e, a, t in written]}], schema)
        if story is not None and not with_messages:
            yield _out([story.digest()], schema)

    return run


def _struct(conv: T.DataType, *fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(", ".join(fields)).fields])


def _solved(rows: DataFrame, with_messages: bool) -> tuple[DataFrame, DataFrame]:
    conv = rows.schema["conv_id"].dataType
    prefix = F.substring("text", 1, PREFIX)
    nulls_first = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    dealt = _classed(rows).repartitionByRange(*nulls_first, prefix.asc_nulls_first()).sortWithinPartitions(*nulls_first, F.col("text").asc_nulls_first())
    cut = _struct(conv, "whole boolean, part int, seq int", _BLOCK, _DIGEST, *([_MESSAGES] if with_messages else []))
    parts = write_table(dealt.mapInArrow(_cut(_arrow(cut), with_messages), cut)).rows

    blocks = parts.where(~F.col("whole")).select("conv_id", "part", "seq", *[f.name for f in T._parse_datatype_string(_BLOCK).fields])
    costs = _struct(conv, "part int, seq int, costs array<long>")
    chain = blocks.withColumn("texts", F.transform("texts", lambda _: F.lit(""))).mapInArrow(_block_costs(_arrow(costs)), costs)
    pay = T._parse_datatype_string("part int, seq int, last boolean, behind array<long>")
    chain = chain.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(_still_to_pay(_arrow(pay)), pay)
    known = blocks.join(chain, ["part", "seq"]).select("conv_id", *[c for c in blocks.columns if c != "conv_id"], "last", "behind")
    lettered = T.StructType([*known.schema.fields, T.StructField("letters", T.ArrayType(T.StringType()))])
    known = known.mapInArrow(_letters(_arrow(lettered)), lettered).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    done = _struct(conv, "part int, seq int", _MESSAGES) if with_messages else _struct(conv, _DIGEST)
    return parts.where("whole"), known.mapInArrow(_finish(_arrow(done), with_messages), done)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    rows has conv_id, turn (long), role and text, and may have copies (how
    often a row stands there; 0 only names its conversation); other columns
    are left out. They are taken by turn (nulls first), then role, then text.
    A null role or text counts as one space. A null conv_id is a conversation
    like others. Each row's first fault counts: blank, duplicate (role and
    text seen earlier) or truncated. Edits are K, R, D and I (see the costs
    above); of the cheapest, the audit that reads least in ASCII is taken.
    No rows give an empty audit and the digest of nothing.

    A digest of a whole conversation is sequential: the texts of one that
    spans blocks pass one task in order, one block in memory at a time, and
    its audit is one string.
    """
    whole, rest = _solved(_given(rows), False)
    return whole.select(*rest.columns).unionByName(rest)


def repaired_messages(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired turns themselves, position from 0. rows as in repair."""
    whole, rest = _solved(_given(rows), True)
    turns = whole.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("seq"), "messages").unionByName(rest)
    sizes = turns.select("conv_id", "part", "seq", F.size("messages").alias("n"))
    before = F.sum("n").over(_in_order())
    begun = sizes.select("part", "seq", F.col("conv_id").alias("_c"), (before - F.col("n")).alias("begun"))
    spread = turns.join(begun, (turns["part"] == begun["part"]) & (turns["seq"] == begun["seq"]) & turns["conv_id"].eqNullSafe(begun["_c"])).select("conv_id", "begun", F.posexplode("messages").alias("at", "m"))
    return spread.select("conv_id", (F.col("begun") + F.col("at")).alias("position"), "m.edit", "m.role", "m.text")


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("part", "seq")


def _given(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies: Column = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.when(copies > 0, text(c)).alias(c) for c in ("role", "text")], copies.alias("copies"))
