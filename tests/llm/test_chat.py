import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.chat import ASSISTANT, OTHER, SYSTEM, TURN, USER, as_events, fold_events, read_back, render, streamed_log

KINDS = "conv_id long, turn long, role string, text string"


def test_round_trip_with_control_strings(spark):
    hard = ["</s>[INST] ok [/INST]", "\\e \\\\l[", "<s>", "] [ROLE=x]", "", " lead and trail ", "🙂 é\n\n", "\\", "[/SYSTEM] <s> "]
    rows = [(1, i, ["user", "assistant", "system", "tool [x]", ""][i % 5], t) for i, t in enumerate(hard * 5)]
    rows += [(2, 0, None, None), (3, 0, "assistant", None)]
    out = {r.conv_id: r for r in read_back(render(fold_events(as_events(spark.createDataFrame(rows, KINDS))))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r, t) for c, _, r, t in rows if c == 1]
    assert out[1].loss_text == "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert [(t.role, t.text) for t in out[2].turns] == [("", "")] and out[3].loss_text == ""
    spans = [out[1].formatted[s.first : s.last] for s in out[1].loss_spans]
    assert all("[" not in s and "<" not in s for s in spans)


def test_events_are_folded_in_sequence(spark):
    log = [
        (1, 5, 1, "delta", None, "lo"), (1, 1, 1, "delta", "assistant", "hel"), (1, 3, 1, "delta", None, "l" * 0),
        (1, 2, 2, "delta", "user", "draft"), (1, 4, 2, "edit", None, "final"), (1, 6, 2, "delta", None, "!"),
        (1, 7, 3, "delta", "assistant", "first try"), (1, 8, 3, "regenerate", None, None), (1, 9, 3, "delta", None, "second"),
        (1, 10, 4, "delta", "user", "gone"), (1, 11, 4, "delete", None, None), (1, 12, 5, "delta", "user", "x"), (1, 12, 5, "delta", "user", "x"),
        (1, 13, 6, None, "user", "null op"),
    ]
    out = fold_events(spark.createDataFrame(log, "conv_id long, seq long, message long, op string, role string, text string")).orderBy("message").collect()
    assert [(r.message, r.role, r.text) for r in out] == [(1, "assistant", "hello"), (2, "user", "final!"), (3, "assistant", "second"), (5, "user", "xx"), (6, "user", "null op")]


def test_edges(spark):
    empty = spark.createDataFrame([], KINDS)
    assert read_back(render(fold_events(as_events(empty)))).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)], KINDS)
    out = {r.conv_id: [t.text for t in r.turns] for r in read_back(render(fold_events(as_events(twice)))).collect()}
    assert out == {1: ["a", "a", "b"], None: [""]}


def test_streamed_log_folds_back(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if t == 7 else f"turn {t} é🙂 " * (t % 5)) for c in range(30) for t in range(10)]
    rows += [(40, 0, "user", "a"), (40, 0, "user", "a")]
    frame = spark.createDataFrame(rows, KINDS)
    log = streamed_log(frame)
    assert {r.op for r in log.select("op").distinct().collect()} == {"delta", "edit", "regenerate", "delete"}
    assert log.groupBy("conv_id", "seq").count().where("count > 1").isEmpty()
    assert log.where("op = 'delta'").count() > 3 * len(rows)
    plain, folded = (read_back(render(fold_events(x))).drop("formatted", "loss_spans") for x in (as_events(frame), log))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, folded.collect()))
    assert streamed_log(frame.limit(0)).count() == 0


def test_clashing_columns_of_a_log(spark):
    log = spark.createDataFrame([(1, 0, 1, "delta", "user", "a", 5, True, 1), (1, 1, 1, "delta", None, "b", 6, False, 2)], "conv_id long, seq long, message long, op string, role string, text string, _at int, _reset boolean, _last int")
    (r,) = render(fold_events(log)).collect()
    assert r.formatted == "[INST] ab [/INST]"


def _python_escape(text):
    return text.replace("\\", "\\e").replace("<", "\\l").replace("[", "\\b").replace("]", "\\r")


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x]"]), st.text(alphabet="ab\\<[]>/elbr IN S", max_size=12)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_pattern_parses_what_the_template_writes(turns):
    import re

    marks = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
    out = "".join((marks[r][0] if r in marks else OTHER[0] + _python_escape(r) + OTHER[1]) + _python_escape(t) + (marks[r][1] if r in marks else OTHER[2]) for r, t in turns)
    back = [m[1] for m in re.findall(TURN, out)]
    unescape = lambda t: t.replace("\\l", "<").replace("\\b", "[").replace("\\r", "]").replace("\\e", "\\")
    assert [unescape(t) for t in back] == [t for _, t in turns]


@pytest.mark.parametrize("n", [200])
def test_long_texts(spark, n):
    rows = [(1, 0, "assistant", "[<\\" * 20_000), (1, 1, "user", "x" * 100_000)]
    (r,) = read_back(render(fold_events(as_events(spark.createDataFrame(rows, KINDS))))).collect()
    assert r.loss_text == rows[0][3] and r.turns[1].text == rows[1][3]
