"""Chat formatting: conversations rebuilt from their event logs, then rendered with a loss mask.

Everything here is a Spark SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the template: what opens and closes a turn of each role.
SYSTEM = ("[SYSTEM] ", " [/SYSTEM]")
USER = ("[INST] ", " [/INST]")
ASSISTANT = ("<s> ", " </s>")
OTHER = ("[ROLE=", "] ", " [/ROLE]")
#: Deltas in which streamed_log writes a text.
PIECES = 4
#: A turn in the output. Escaped texts hold neither [ nor <, so a turn ends where the next such character stands.
TURN = r"(?s)(\[SYSTEM\]|\[INST\]|<s>|\[ROLE=[^\[<\]]*\]) ([^\[<]*) (?:\[/SYSTEM\]|\[/INST\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    """Takes [, < and ] out of a text, so that no control string can stand in it; a backslash always begins an escape."""
    for raw, safe in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("<", "\\l"), ("[", "\\b"), ("]", "\\r"), ("\\", "\\e")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, message, op, role, text).

    Ops, in the order of seq within a message: `delta` appends its text,
    `edit` replaces all so far by its text, `regenerate` drops all so far (a
    text it carries begins the new answer), `delete` removes the message
    unless later events write it again. Unknown and null ops count as delta, a
    null text is empty, the role is the last one that isn't null. Events with
    one seq are folded in the order of op, then text; repeated events count
    each. Only what follows the last replacing event of a message is gathered,
    so a message's rows are as many as the pieces of its final text.
    """
    order = [F.col("seq").asc_nulls_first(), F.col("op").asc_nulls_first(), F.col("text").asc_nulls_first()]
    mine = W.partitionBy("conv_id", "message").orderBy(*order)
    resets = F.coalesce(F.col("op").isin("edit", "regenerate", "delete"), F.lit(False))
    marked = events.withColumn("_at", F.row_number().over(mine)).withColumn("_reset", resets)
    whole = W.partitionBy("conv_id", "message")
    last = F.max(F.when(F.col("_reset"), F.col("_at"))).over(whole)
    marked = marked.withColumn("_last", F.coalesce(last, F.lit(0)))
    shown = (F.col("_at") >= F.col("_last")) & ~F.coalesce(F.col("op") == "delete", F.lit(False))
    piece = F.when(shown, F.struct("_at", F.coalesce("text", F.lit("")).alias("text")))
    folded = marked.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(piece)).alias("_pieces"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_at"))).alias("role"),
    )
    text = F.array_join(F.transform("_pieces", lambda p: p["text"]), "")
    return folded.where(F.size("_pieces") > 0).select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): a conversation as one string, and the spans of assistant texts in it.

    Spans are half-open and count code points of formatted. Messages stand in
    the order of message, ties by role and text; null texts are empty. A
    conversation is one row by its nature, so its own turns are gathered; no
    rows give no conversations.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    opening = F.when(role == "system", SYSTEM[0]).when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0]).otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])))
    closing = F.when(role == "system", SYSTEM[1]).when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).otherwise(F.lit(OTHER[2]))
    turns = messages.select("conv_id", "message", role.alias("role"), text.alias("text"), opening.alias("opening"), closing.alias("closing"))
    size = F.length("opening").cast("long") + F.length("text") + F.length("closing")
    so_far = W.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("message", "role", "text")]).rowsBetween(W.unboundedPreceding, W.currentRow)
    turn = F.struct(F.sum(size).over(so_far).alias("end"), "role", "text", "opening", "closing")
    gathered = turns.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["opening"], t["text"], t["closing"])), "")

    def span(t: Column) -> Column:
        last = t["end"] - F.length(t["closing"])
        return F.struct((last - F.length(t["text"])).alias("first"), last.alias("last"))

    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), span)
    return gathered.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text (all text under the mask, unescaped), read from formatted alone."""
    tags, texts = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1)), F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))

    def role(tag: Column) -> Column:
        named = unescape(F.regexp_extract(tag, r"^\[ROLE=(.*)\]$", 1))
        return F.when(tag == "[SYSTEM]", "system").when(tag == "[INST]", "user").when(tag == "<s>", "assistant").otherwise(named)

    turns = F.zip_with(tags, texts, lambda a, b: F.struct(role(a).alias("role"), unescape(b).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int"))))
    return rendered.withColumns({"turns": turns, "loss_text": F.array_join(masked, "")})


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: each row is a message of its own, written by one delta.

    Rows of a conversation are numbered in the order of turn, then role and
    text (nulls first), so repeated turns stay apart.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    message = F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).cast("long")
    return conversations.select("conv_id", message.alias("message"), F.lit(0).cast("long").alias("seq"), F.lit("delta").alias("op"), "role", "text")


def streamed_log(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as the log of a chat service would hold them; folding it gives the turns back.

    Each text arrives in PIECES deltas. A hash of conversation and message
    picks turns that were first something else (the text reversed) and then
    regenerated, with or without a text, edited, or deleted and written again,
    and turns beside which a message was begun and withdrawn. seq numbers the
    events of a conversation. Rows are ordered as in as_events.
    """
    turns = as_events(conversations).withColumn("text", F.coalesce("text", F.lit("")))
    long = F.greatest(F.ceil(F.length("text") / PIECES), F.lit(1)).cast("int")
    own, beside = 2 * F.col("message"), 2 * F.col("message") + 1

    def event(op: str, text: Column, message: Column = own) -> Column:
        return F.struct(message.alias("message"), F.lit(op).alias("op"), text.alias("text"))

    first, nothing, draft = F.substring(F.col("text"), F.lit(1), long), F.lit(None).cast("string"), F.reverse("text")
    rest = [event("delta", F.substring(F.col("text"), i * long + 1, long)) for i in range(1, PIECES)]
    histories = [
        [event("delta", draft), event("regenerate", nothing), event("delta", first), *rest],
        [event("delta", draft), event("edit", first), *rest],
        [event("delta", draft), event("delete", nothing), event("delta", first), *rest],
        [event("delta", draft), event("regenerate", first), *rest],
        [event("delta", draft, beside), event("delta", first), *rest, event("delete", nothing, beside)],
    ]
    kind = F.pmod(F.xxhash64("conv_id", "message"), F.lit(2 * len(histories)))
    events = F.array(event("delta", first), *rest)
    for i, history in enumerate(histories):
        events = F.when(kind == i, F.array(*history)).otherwise(events)
    log = turns.select("conv_id", F.col("message").alias("turn"), "role", F.posexplode(events).alias("at", "event"))
    return log.select("conv_id", F.col("event.message").alias("message"), (16 * F.col("turn") + F.col("at")).alias("seq"), F.col("event.op").alias("op"), "role", F.col("event.text").alias("text"))
