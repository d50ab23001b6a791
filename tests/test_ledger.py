import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyspark.streaming.ledger import HELD, SHORT, _Ledger, keyed_state, ledger_stream, run_to_end

SCHEMA = "chan string, seq long, n long"


def plain(rows):
    out, state = [], {}
    for chan, seq, n in sorted(rows, key=lambda r: r[1]):
        last, highest, head, seen = state.get(chan, (0, None, "g", {}))
        head = hashlib.sha256((head + str(seq)).encode()).hexdigest()
        seen = seen | {n: seen.get(n, 0) + 1}
        out.append((chan, seq, n, last + 1, highest, seen[n], head))
        state[chan] = (n, n if highest is None else max(n, highest), head, seen)
    return sorted(out, key=lambda r: r[1])


def told(spark, folder):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    return ledger_stream(stream, ["chan"], [F.col("seq")], F.col("n"), F.col("n"), F.col("seq"), genesis="g")


def test_a_restart_in_mid_stream_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    rows = [("a" if i % 3 else "b", i, [1, 2, 3, 3, 5, 4, 9][i % 7] + i // 7) for i in range(60)] + [(None, 60, 1), (None, 61, 3)]
    for part in (rows[:25], rows[25:26], rows[26:]):
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(f"{folder}/in")
        run_to_end(told(spark, folder), f"{folder}/out", f"{folder}/checkpoint")
    run_to_end(told(spark, folder), f"{folder}/out", f"{folder}/checkpoint")
    assert sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=lambda r: r[1]) == plain(rows)


def test_null_counters_fail_the_stream(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("a", 1, None)], SCHEMA).write.parquet(f"{folder}/in")
    with pytest.raises(Exception, match="need a counter"):
        run_to_end(told(spark, folder), f"{folder}/out", f"{folder}/checkpoint")


def test_the_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


def test_more_identities_than_a_value_holds(spark, tmp_path):
    """A channel whose identities lie in its value, in entries of their own, or are long, met again after restarts."""
    folder = str(tmp_path)
    rows = [("a", i, (i * 7) % (HELD + 90)) for i in range(900)] + [("b", 900 + i, i % 3) for i in range(60)]
    for part in (rows[:200], rows[200:500], rows[500:]):
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        identity = F.when(F.col("n") % 5 == 0, F.lpad(F.col("n").cast("string"), SHORT + 1, "x")).otherwise(F.col("n").cast("string"))
        run_to_end(ledger_stream(stream, ["chan"], [F.col("seq")], F.col("n"), identity, F.col("seq"), genesis="g"), f"{folder}/out", f"{folder}/checkpoint")
    assert sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=lambda r: r[1]) == plain(rows)


class Told:
    """State of one channel in memory, and how many messages it took."""

    def __init__(self):
        self.value, self.entries, self.messages = None, {}, 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def get(self):
        self.messages += 1
        return self.value

    def update(self, value):
        self.messages += 1
        self.value = value

    def getValue(self, key):
        self.messages += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.messages += 1
        self.entries[key] = value


def test_messages_for_state_grow_with_channels_not_with_rows():
    told, rows, out = Told(), [("a", i, i % 200) for i in range(3000)], []
    fields = Row("chan", "seq", "n", "_counter", "_identity", "_leaf", "_order")
    for part in (rows[:1000], rows[1000:]):
        ledger = _Ledger("g")
        ledger.init(told)
        out += ledger.handleInputRows(("a",), (fields(*r, r[2], str(r[2]), str(r[1]), f"{r[1]:09}") for r in reversed(part)), None)
    assert told.messages == 4 and not told.entries and [tuple(r) for r in out] == plain(rows)
