"""Counters, replays and chain heads over streams, as keyed state that outlives a restart."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FACTS = "expected long, highest_before long, occurrence long, head string"


#: Identities of a channel that lie in its own value, and characters of one that does; all others have a state entry each.
HELD, SHORT = 256, 64


class _Ledger(StatefulProcessor):
    """State of a channel: its last and highest counter, its head, and how often each identity was seen.

    Each look at the state is a message to the JVM, so the first HELD
    identities (JSON, identity to times) come and go with the rest in one
    value; a longer history doesn't make it larger.
    """

    def __init__(self, genesis: str) -> None:
        self.genesis = genesis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "last long, highest long, head string, held string, more boolean")
        self.seen = handle.getMapState("seen", "identity string", "times long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A micro-batch's rows of one channel, in order; batches follow each other in the order of the stream.
        last, highest, head, text, more = self.at.get() or (0, None, self.genesis, "{}", False)
        held, others, out = json.loads(text), {}, None
        before = more
        for row in sorted(rows, key=lambda r: r[-1]):
            *columns, counter, identity, leaf, _ = row
            if identity in held or (len(held) < HELD and len(identity) <= SHORT):
                times = held[identity] = held.get(identity, 0) + 1
            else:
                if identity not in others:
                    others[identity] = (self.seen.getValue((identity,)) or (0,))[0] if before else 0
                times = others[identity] = others[identity] + 1
                more = True
            head = hashlib.sha256((head + leaf).encode()).hexdigest()
            out = out or Row(*row.__fields__[: len(columns)], "expected", "highest_before", "occurrence", "head")
            yield out(*columns, last + 1, highest, times, head)
            last, highest = counter, counter if highest is None else max(highest, counter)
        for identity, times in others.items():
            self.seen.updateValue((identity,), (times,))
        self.at.update((last, highest, head, json.dumps(held), more))

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, channel: list[str], order: list[Column], counter: Column, identity: Column, leaf: Column, genesis: str = "") -> DataFrame:
    """A stream's rows with what their channel's past says of each, in append mode.

    expected: one more than the counter before it (1 at first), so a strict
    counter has a gap or a repeat where its own differs. highest_before: null
    at first. occurrence: how often the channel has seen this identity, this
    row included. head: sha256 of the head before it and its leaf, the first
    on genesis. Rows of a micro-batch are taken by order (whole numbers), which must have no
    ties, and must not come before those of earlier ones; one channel's part
    of a micro-batch is held in memory, so the trigger bounds it. Null counters,
    identities or leaves fail the stream. The state costs two messages for a
    channel and micro-batch, and two for each identity beyond HELD.
    """
    needed = {"_counter": counter.cast("long"), "_identity": identity.cast("string"), "_leaf": leaf.cast("string")}
    sound = F.lit(True)
    for value in needed.values():
        sound = sound & value.isNotNull()
    checked = F.when(sound, needed["_counter"]).otherwise(F.raise_error(F.lit("a ledger's rows need a counter, an identity and a leaf")).cast("long"))
    # The order reaches Python as text, its whole numbers of one width.
    key = F.concat_ws("|", *[F.lpad((o.cast("decimal(38,0)") + F.lit("100000000000000000000").cast("decimal(38,0)")).cast("string"), 24, "0") for o in order])
    rows = events.withColumns(needed | {"_counter": checked, "_order": key})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields), FACTS])
    return rows.groupBy(*channel).transformWithState(_Ledger(genesis), outputStructType=schema, outputMode="Append", timeMode="None")


@contextmanager
def keyed_state(spark: SparkSession):
    """While it holds, queries that start keep their state in RocksDB, which this kind of state needs; the setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_to_end(stream: DataFrame, into: str, checkpoint: str) -> None:
    """Everything that has come, appended as Parquet; called again with the same checkpoint it goes on where it ended."""
    with keyed_state(stream.sparkSession):
        query: StreamingQuery = stream.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
