"""Records replayed from logs, canonical JSON, fragments, retrieval traces and manifests as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.text import fold_ascii, holds

#: Operations that are logged but change no record.
INERT = ["LOG", "DELETE", "DISPOSE", "PURGE", "DESTROY"]


def canonical_json(fields: Column) -> Column:
    """A map of strings as compact JSON with sorted keys; a null value is written as null. Texts stay as they are, but for what JSON must escape, in small hex digits."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))), {"ignoreNullFields": "false"})
    small = text
    for digit in "ABCDEF":
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(F.contains(text, F.lit("\\u00")), small).otherwise(text)


def replay(events: DataFrame, record: str, order: list[str], op: str, patch: str) -> DataFrame:
    """(record, status, state, digest) after all events of each record.

    CREATE must come once, before any AMEND; AMEND overwrites the fields that
    its patch (a map of strings) names, with null as a value like any other;
    INERT operations change nothing; others are unknown. A log that breaks
    this has a status instead of a state. Fields are folded as the last value
    of each (record, field), so no log is gathered, only its final fields.
    """
    at = F.struct(*order)
    acts = events.select(record, at.alias("_at"), F.col(op).alias("_op"), F.col(patch).alias("_patch"))
    created, amended = F.col("_op") == "CREATE", F.col("_op") == "AMEND"
    shape = acts.groupBy(record).agg(
        F.count_if(created).alias("creates"),
        F.min(F.when(created, F.col("_at"))).alias("born"),
        F.min(F.when(amended, F.col("_at"))).alias("first"),
        F.count_if(~F.coalesce(created | amended | F.col("_op").isin(INERT), F.lit(False))).alias("unknown"),
        F.count_if((created | amended) & F.col("_patch").isNull()).alias("bare"),
    )
    status = (
        F.when(F.col("unknown") > 0, "unknown operation")
        .when(F.col("creates") == 0, "no create")
        .when(F.col("creates") > 1, "second create")
        .when(F.col("first") < F.col("born"), "amend before create")
        .when(F.col("bare") > 0, "no fields")
        .otherwise("replayed")
    )
    written = acts.where(created | amended).select(record, "_at", F.explode("_patch").alias("_field", "_value"))
    last = written.groupBy(record, "_field").agg(F.max_by(F.struct("_value"), "_at").alias("_last"))
    fields = last.groupBy(record).agg(F.map_from_entries(F.collect_list(F.struct("_field", "_last._value"))).alias("_state"))
    empty = F.create_map().cast("map<string,string>")
    state = F.when(F.col("status") == "replayed", canonical_json(F.coalesce("_state", empty)))
    return shape.withColumn("status", status).join(fields, record, "left").select(record, "status", state.alias("state"), F.sha2(state, 256).alias("digest"))


def merge_maps(left: Column, right: Column) -> Column:
    """Two maps of maps: keys of both are merged one level deep, the right side's values win."""

    def over(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    merged = F.transform_values(right, lambda k, v: F.when(F.map_contains_key(left, k) & v.isNotNull() & left[k].isNotNull(), over(left[k], v)).otherwise(v))
    return over(left, merged)


def resolve_many(df: DataFrame, corpus: DataFrame, key: str, record: str, keys: str, columns: list[str]) -> DataFrame:
    """Left join on any of the keys (an array) by which a record is known; adds columns and resolved. A key of two different records fails.

    Keys are compared with case folded and white space collapsed; a record
    that lists a key twice is one.
    """
    known = corpus.select(record, *columns, F.explode(F.array_distinct(F.transform(keys, fold_ascii))).alias("_key"))
    index = known.groupBy("_key").agg(F.count_distinct(record).alias("_n"), *[F.first(c).alias(c) for c in columns])
    one = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key of two records: "), F.col("_key")))).otherwise(F.lit(True)).cast("boolean")
    joined = df.withColumn("_key", fold_ascii(F.col(key))).join(index.withColumn("resolved", one).drop("_n"), "_key", "left")
    return joined.withColumn("resolved", F.coalesce("resolved", F.lit(False))).drop("_key")


def confidence_band(score: Column, low: float, high: float, places: int = 6) -> tuple[Column, Column]:
    """The score times its two factors, rounded."""
    return F.round(score * low, places), F.round(score * high, places)


#: The fields of all five kinds of fragment.
FRAGMENT = "kind string, source_cid string, start long, end long, sentence_index long, page long, x0 double, y0 double, x1 double, y1 double, timestamp_iso string, sensor_id string, sample_index long, kind_tag string, locator map<string,string>"
#: What each kind must have.
NEEDED = {
    "byte_offset": ["source_cid", "start", "end"],
    "sentence_id": ["source_cid", "sentence_index"],
    "page_coord": ["source_cid", "page", "x0", "y0", "x1", "y1"],
    "timestamp_sample": ["source_cid", "timestamp_iso", "sensor_id", "sample_index"],
    "opaque": ["source_cid", "kind_tag", "locator"],
}


def fragments(df: DataFrame, text: str) -> DataFrame:
    """Adds fragment (a struct of FRAGMENT) read from JSON and reason: null if it is valid, else what is wrong first."""
    f = lambda name: F.col(f"fragment.{name}")
    kind = f("kind")
    bounds = {
        "byte_offset": (f("start") < 0) | (f("end") <= f("start")),
        "sentence_id": f("sentence_index") < 0,
        "page_coord": (f("page") < 1) | (f("x1") <= f("x0")) | (f("y1") <= f("y0")),
        "timestamp_sample": f("sample_index") < 0,
        "opaque": (F.length(f("kind_tag")) == 0) | f("kind_tag").isin(list(NEEDED)),
    }
    reason = F.when(kind.isNull(), "no kind").when(~kind.isin(list(NEEDED)), "unknown kind")
    for name, needed in NEEDED.items():
        missing = [f(n).isNull() for n in needed]
        reason = reason.when((kind == name) & F.array_contains(F.array(*missing), True), "missing field").when((kind == name) & bounds[name], "out of bounds")
    return df.withColumn("fragment", F.from_json(text, FRAGMENT)).withColumn("reason", reason)


def trace_faults(df: DataFrame, candidates: str, selected: str, context: str, scores: str, named: list[str]) -> DataFrame:
    """Rows of traces that are not well formed: an empty name, a score that is null or not finite, or sets that do not contain each other. reason says which first."""
    nameless = F.array_contains(F.array(*[F.coalesce(F.length(n) == 0, F.lit(True)) for n in named]), True)
    unfit = F.exists(scores, lambda s: s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")))
    reason = (
        F.when(nameless, "empty name")
        .when(unfit, "score not finite")
        .when(F.size(F.array_except(selected, candidates)) > 0, "selected not in candidates")
        .when(F.size(F.array_except(context, selected)) > 0, "context not in selected")
    )
    return df.withColumn("reason", reason).where("reason is not null")


def three_set_mismatch(stored: DataFrame, traces: DataFrame, trace: str) -> DataFrame:
    """(output, reason) of outputs whose stored sets aren't those that their trace gives.

    stored: (output, trace, retrieved, injected, quoted); traces: (trace,
    candidates, context), a trace held twice is ambiguous. What is quoted is
    what the context has of it, in the context's order.
    """
    one = traces.groupBy(trace).agg(F.count(F.lit(1)).alias("_n"), F.first("candidates").alias("candidates"), F.first("context").alias("context"))
    both = stored.join(one, trace, "left")
    derived = F.filter("context", lambda c: F.array_contains(F.col("quoted"), c))
    reason = (
        F.when(F.col("_n").isNull(), "no trace")
        .when(F.col("_n") > 1, "ambiguous trace")
        .when(F.size(F.array_except("context", "candidates")) > 0, "context not retrieved")
        .when(F.size(F.array_except("quoted", "context")) > 0, "quote not in context")
        .when(~(F.col("retrieved") == F.col("candidates")) | ~(F.col("injected") == F.col("context")) | (F.col("quoted") != derived), "stored differs")
    )
    return both.select("output", reason.alias("reason")).where("reason is not null")


def above_ceiling(df: DataFrame, profile: str, observed: str, ceilings: dict[str, int]) -> DataFrame:
    """Rows observed above their profile's ceiling, or of a profile that has none."""
    most = F.create_map(*[F.lit(x) for pair in ceilings.items() for x in pair])[F.col(profile)]
    return df.withColumn("reason", F.when(most.isNull(), "no such profile").when(F.col(observed) > most, "above the ceiling")).where("reason is not null")


def manifest_fields(df: DataFrame, fields: str, header_version: str, banned: list[str]) -> DataFrame:
    """A row per fault of a manifest (a map): its version differs from the header's where both have one, or a banned field is there."""
    version = F.col(fields)["schema_version"]
    differs = (F.length(version) > 0) & (F.length(header_version) > 0) & (version != F.col(header_version))
    stale = F.arrays_overlap(F.map_keys(fields), F.array(*[F.lit(b) for b in banned]))
    faults = F.array(F.when(differs, F.lit("versions differ")), F.when(stale, F.lit("banned field")))
    return df.withColumn("reason", F.explode(F.filter(faults, lambda x: x.isNotNull())))


def extractive(segments: DataFrame, sources: DataFrame, output: str, quotable: DataFrame) -> DataFrame:
    """(output, kept, text): the segments (output, at, source, text) that quote their source, in order.

    One stays if it has a source among quotable (output, source), has text
    after folding and stands in the text of sources (source, whole). An output
    of which nothing stays has the empty text.
    """
    stamped = segments.join(quotable.select(output, "source").distinct(), [output, "source"], "left_semi").join(sources.select("source", "whole"), "source")
    kept = stamped.where(holds(fold_ascii(F.col("whole")), fold_ascii(F.col("text"))))
    texts = kept.groupBy(output).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("_kept"))
    all_ = segments.select(output).distinct().join(texts, output, "left")
    return all_.select(output, F.coalesce(F.size("_kept"), F.lit(0)).cast("long").alias("kept"), F.coalesce(F.array_join(F.transform("_kept", lambda s: s["text"]), ""), F.lit("")).alias("text"))


def path_order(df: DataFrame, group: str, path: str) -> DataFrame:
    """Adds rank: paths of a group in the order of their segments, so that a folder stands right before what it holds."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.split(path, "/"))).cast("long"))
