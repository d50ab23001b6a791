"""Nested JSON of any shape: a walk of VARIANT values as relations, level by level, with admission and non-finite numbers; canonical text, document by document.

A level is one relation of nodes; only objects and arrays go on to the next,
so the walk takes as many steps as the deepest document has levels, whatever
the number of documents. Documents are bounded by admission before it begins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.sources.files import MAX_BYTES, MAX_DEPTH, MAX_ENTRIES, bracket_shape
from tallyspark.sources.lineage import cut

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A mark that no JSON text may hold, put behind strings, fractions and words for numbers that aren't finite.
_MARK = "\u0000"
#: What stands for NaN in a parsed value, as JSON has no number for it.
NAN = "\u0000NaN\u0000"


def parse_exact(raw: Column) -> Column:
    """A JSON text as VARIANT in which every number written with a point or an exponent is a double, whole ones stay whole.

    NaN, Infinity and -Infinity are numbers, as in common JSON writers. Null
    for what is no JSON document, has something behind it, repeats a key in
    one object, or has a whole number of over 38 digits.
    """
    marked = F.regexp_replace(raw, rf"(?s)({_STRING}|[0-9]++\.[0-9]++(?![0-9eE])|NaN|Infinity)", "$1" + _MARK)
    plain = F.replace(marked, F.lit('"' + _MARK), F.lit('"'))
    plain = F.replace(plain, F.lit("NaN" + _MARK), F.lit('"\\u0000NaN\\u0000"'))
    plain = F.replace(F.replace(plain, F.lit("Infinity" + _MARK), F.lit("1e999")), F.lit(_MARK), F.lit("e0"))
    bare = F.trim(F.regexp_replace(raw, rf"(?s){_STRING}", '""'), F.lit(" \t\n\r"))
    # The parser stops behind the first value: brackets may close only at the end, and a bare scalar is one token.
    once = F.exists(F.array(bracket_shape(raw)), lambda s: (s["least"] == 0) & (s["last"] == 0) & (s["tops"] <= 1))
    whole = bare.rlike(r"(?s)^(?:[\[{].*[\]}]|[^\s\[\]{}]++)$")
    readable = once & whole & ~F.contains(raw, F.lit(_MARK)) & ~bare.rlike(r"(?<![0-9.eE+-])-?[0-9]{39,}+(?![.eE])")
    return F.try_parse_json(F.when(readable, plain))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _step(step: Column) -> Column:
    """One step of a JSON pointer."""
    return F.replace(F.replace(step, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _with_node(df: DataFrame, *keep: Column) -> DataFrame:
    """The columns kept, with kind, entries and text of the value `it`, and the value itself only if it is a collection: a scalar needs no copy of its document's keys.

    kind is object, array, string, boolean, null, whole or number (a double). In steps, so that no value is taken apart twice.
    """
    df = df.withColumns({"_map": _as(F.col("it"), "map<string,variant>"), "_list": _as(F.col("it"), "array<variant>")})
    df = df.withColumn("_held", F.col("_map").isNotNull() | F.col("_list").isNotNull())
    df = df.withColumns({"_type": F.schema_of_variant(F.when(~F.col("_held"), F.col("it"))), "_text": F.when(~F.col("_held"), _as(F.col("it"), "string"))})
    nan, kind = F.col("_text") == NAN, F.col("_type")
    scalar = F.when(kind == "VOID", "null").when(kind == "STRING", F.when(nan, "number").otherwise("string")).when(kind == "BOOLEAN", "boolean").when(kind.isin("DOUBLE", "FLOAT"), "number").otherwise("whole")
    named = F.when(F.col("_map").isNotNull(), "object").when(F.col("_list").isNotNull(), "array").otherwise(scalar)
    entries = F.coalesce(F.size("_map"), F.size("_list"), F.lit(0))
    return df.select(*keep, named.alias("kind"), entries.alias("entries"), F.when(nan, "NaN").otherwise(F.col("_text")).alias("text"), F.when(F.col("_held"), F.col("it")).alias("value"))


def walk(docs: DataFrame, key: str, value: Column, max_depth: int = MAX_DEPTH, max_entries: int = MAX_ENTRIES) -> list[DataFrame]:
    """The nodes of each document by level: (key, path, parent, step, depth, kind, entries, text, value).

    path is a JSON pointer, depth counts from 1, step is the key or index
    below the parent. The walk ends one level below max_depth and does not
    enter collections of more than max_entries, so breaches of both show.
    Documents whose value is null have no nodes. key must be unique.
    """
    root = docs.select(F.col(key).alias("key"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("step"), F.lit(1).alias("depth"), value.alias("it")).where("it IS NOT NULL")
    level = cut(_with_node(root, *[F.col(c) for c in ("key", "path", "parent", "step", "depth")]))
    levels = [level]
    for depth in range(2, max_depth + 2):
        into = level.where(F.col("entries").between(1, max_entries))
        if into.isEmpty():
            break
        keyed = F.map_entries(_as(F.col("value"), "map<string,variant>"))
        listed = F.transform(_as(F.col("value"), "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
        below = F.explode(F.when(F.col("kind") == "object", keyed).otherwise(listed))
        below = into.select("key", F.col("path").alias("parent"), below.alias("e")).select("key", "parent", F.col("e.key").alias("step"), F.col("e.value").alias("it"))
        path = F.concat("parent", F.lit("/"), _step(F.col("step")))
        level = cut(_with_node(below, F.col("key"), path.alias("path"), F.col("parent"), F.col("step"), F.lit(depth).alias("depth")))
        levels.append(level)
    return levels


def _union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [level.drop("value") for level in levels])


def admit_nested(docs: DataFrame, key: str, raw: str, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(key, verdict, path, found) of each JSON text: its first breach, or ok with null and how many nodes it has.

    too_large (bytes) and too_deep (brackets) are decided before a text is
    parsed and have no path; then not_json, too_many (entries of one
    collection) and not_finite (a number that is infinite or NaN), each with
    the path of the first: the least depth, then the least path. A null text
    is not_json.
    """
    size, deep = F.octet_length(raw), bracket_shape(F.col(raw))["most"]
    early = F.when(size > max_bytes, "too_large").when(F.when(size <= max_bytes, deep) > max_depth, "too_deep")
    known = cut(docs.select(F.col(key).alias("_key"), early.alias("early"), size.alias("size"), F.when(early.isNull(), parse_exact(F.col(raw))).alias("it"), F.when(F.col(raw).isNotNull() & (size <= max_bytes), deep).alias("deep")))
    nodes = _union(walk(known, "_key", F.col("it"), max_depth, max_entries))
    many, infinite = F.col("entries") > max_entries, F.col("text").isin("NaN", "Infinity", "-Infinity") & (F.col("kind") == "number")
    breach = F.when(many, F.struct("depth", "path", F.lit("too_many").alias("what"), F.col("entries").cast("long").alias("found"))).when(infinite, F.struct("depth", "path", F.lit("not_finite").alias("what"), F.lit(1).cast("long").alias("found")))
    first = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), F.min(breach).alias("breach"))
    verdict = F.coalesce("early", "breach.what", F.when(F.col("nodes").isNull(), "not_json"), F.lit("ok"))
    found = F.when(F.col("early") == "too_large", F.col("size").cast("long")).when(F.col("early") == "too_deep", F.col("deep").cast("long")).otherwise(F.coalesce("breach.found", "nodes"))
    return known.join(first, F.col("_key") == F.col("key"), "left").select(F.col("_key").alias(key), verdict.alias("verdict"), F.col("breach.path").alias("path"), found.alias("found"))


def _whole(digits: str) -> int:
    if len(digits.lstrip("-")) > 38:
        raise ValueError("a whole number of over 38 digits")
    return int(digits)


def _members(pairs: list[tuple[str, object]]) -> dict[str, object]:
    members = dict(pairs)
    if len(members) < len(pairs):
        raise ValueError("a repeated key")
    return members


_READ = json.JSONDecoder(parse_int=_whole, object_pairs_hook=_members).decode
_WRITE = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, check_circular=False).encode


def _canonical(raw: str | None) -> str | None:
    """One text's canonical form; None for what is no document."""
    if raw is None:
        return None
    try:
        text = _WRITE(_READ(raw))
    except ValueError:
        return None
    # Half a surrogate pair, which only an escape can name, has no UTF-8: it becomes a question mark, in keys before they are sorted.
    return text if text.isascii() or (sound := text.encode("utf-8", "replace").decode()) == text else _canonical(sound)


def _canonical_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array(map(_canonical, batch.column(1).to_pylist()), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["key", "canonical"])


def canonical(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, canonical) of each JSON text: keys sorted by code point, no spaces, numbers in their shortest form, text unescaped where JSON allows it.

    Whole numbers stay as written (up to 38 digits), others are doubles:
    1.50 is 1.5, 1e3 is 1000.0, infinite ones are words. Null for texts that
    are inadmissible or no JSON document (see parse_exact), and for null. A
    text is written where it lies, so nothing is shuffled or joined; its
    shortest doubles need Python anyhow.
    """
    size, opened = F.octet_length(raw), sum(F.length(raw) - F.length(F.replace(F.col(raw), F.lit(c), F.lit(""))) for c in "[{")
    # A text with few opening brackets can't be deep, which saves the count of how they nest.
    shallow = F.when(opened <= MAX_DEPTH, True).when(size <= MAX_BYTES, bracket_shape(F.col(raw))["most"] <= MAX_DEPTH)
    texts = docs.select(F.col(key).alias("key"), F.when((size <= MAX_BYTES) & shallow, F.col(raw)).alias("raw"))
    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("canonical", T.StringType())])
    return texts.mapInArrow(_canonical_batches, kind).withColumnRenamed("key", key)
