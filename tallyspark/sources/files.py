"""Bounded readers of the encodings a dataset root may hold, and append-only sinks."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Admission limits of a document, as fixed values: bytes, nesting, entries of one collection.
MAX_BYTES, MAX_DEPTH, MAX_ENTRIES = 16 * 1024 * 1024, 64, 1_000_000


def contained(root: str, relative: str) -> str:
    """The path of a file under a root; absolute paths, parent steps and links that leave it are refused."""
    if os.path.isabs(relative) or ".." in Path(relative).parts:
        raise ValueError(f"path leaves its root: {relative!r}")
    base = Path(root).resolve()
    full = (base / relative).resolve()
    if full != base and base not in full.parents:
        raise ValueError(f"path leaves its root: {relative!r}")
    return str(full)


def bracket_shape(raw: Column) -> Column:
    """How brackets nest in a JSON text, those inside strings left out: most (the depth), least and last (open ones, below 0 if too many close), tops (outermost pairs)."""
    # Possessive: an alternation under * would take a stack frame for each character of a string.
    bare = F.regexp_replace(raw, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    runs = F.regexp_extract_all(bare, F.lit(r"[\[{]++|[\]}]++"), F.lit(0))
    names = ("now", "most", "least", "last", "tops")
    start = F.struct(*[F.lit(0).alias(n) for n in names])

    def step(s: Column, run: Column) -> Column:
        opens, n = run.startswith("[") | run.startswith("{"), F.length(run)
        # An unmatched closing bracket doesn't count against the depth of what follows.
        now = F.when(opens, s["now"] + n).otherwise(F.greatest(s["now"] - n, F.lit(0)))
        last = s["last"] + F.when(opens, n).otherwise(-n)
        tops = s["tops"] + F.when(opens & (s["last"] <= 0), 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"), F.least(s["least"], last).alias("least"), last.alias("last"), tops.alias("tops"))

    return F.aggregate(runs, start, step)


def json_depth(raw: Column) -> Column:
    """How deep brackets nest in a JSON text, those inside strings left out."""
    return bracket_shape(raw)["most"]


def admit(raw: Column, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH) -> Column:
    """`ok`, `too_large` or `too_deep` for a JSON text, decided before it is parsed."""
    return F.when(F.octet_length(raw) > max_bytes, "too_large").when(json_depth(raw) > max_depth, "too_deep").otherwise("ok")


def admit_entries(value: Column, most: int = MAX_ENTRIES) -> Column:
    """Whether a collection (array or map) holds at most so many entries; null has none."""
    return F.coalesce(F.size(value), F.lit(0)) <= most


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One document per file, strictly."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, limits: bool = True) -> DataFrame:
    """A document per line; blank lines are skipped, a bad or inadmissible line fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if limits:
        verdict = admit(F.col("value"))
        lines = lines.where(F.when(verdict != "ok", F.raise_error(F.concat(F.lit("line is "), verdict))).otherwise(F.lit(True)).cast("boolean"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("it")).select("it.*")


def parse_tolerant(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parses a text column; rows that are no such JSON go. Adds the fields of schema."""
    bad = "_bad_json"
    wide = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(bad, T.StringType())])
    parsed = df.withColumn("_it", F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    return parsed.where(F.col("_it").isNotNull() & F.col(f"_it.{bad}").isNull()).select(*df.columns, *[F.col(f"_it.{f.name}").alias(f.name) for f in wide.fields[:-1]])


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document per line; lines that can't be parsed or are inadmissible are skipped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & (admit(F.col("value")) == "ok"))
    return parse_tolerant(lines, "value", schema).drop("value")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column is text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_ordered_json(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """A document per file of a folder, with the file's name to order by."""
    rows = spark.read.schema(schema).json(folder, multiLine=True, mode="FAILFAST")
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """The set of non-blank lines of a word list, stripped."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("word")).where("word <> ''").distinct()


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def cid(content: Column) -> Column:
    """The content address of bytes or text."""
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def files_under(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of every regular file under a root; contents are hashed on the executors."""
    base = Path(root).resolve().as_uri().replace("file://", "file:")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", f"^{base}/", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


#: The kinds of status events, and the properties that decisions are about.
EVENT_TYPES = [
    "ADMISSION_DECISION", "COVERAGE_DRIFT", "CORRECT", "ENTITY_DRIFT", "INGESTION_VERSION_BUMP", "KEY_REVOKED", "LANGUAGE_RECALIBRATION", "RECLASSIFY", "RETRACT", "STRUCTURE_DRIFT", "SUPERSEDE",
]
PROPERTIES = ["issuer_identity_verified", "signed_artifact_present", "publication_class", "external_status_flags"]
_CHUNK = "struct<fragment:string,rank:long,source_cid:string>"
#: Logs by name: the columns of a line, those that may not be null, the allowed values of one, and the key that may stand there once.
LOGS = {
    "status": ("event_type string, source_id string, prior_sha string, new_sha string, detected_at string, metadata map<string,string>", ["event_type", "source_id", "detected_at", "metadata"], ("event_type", EVENT_TYPES), None),
    "trace": (f"trace_id string, retriever_name string, retriever_version string, query string, candidate_set array<string>, rankings array<struct<score:double,source_cid:string>>, selected_chunks array<{_CHUNK}>, context_window array<string>, model_router_version string, captured_at string", ["trace_id", "candidate_set", "selected_chunks", "context_window"], None, "trace_id"),
    "decision": ("source_cid string, property_name string, decided_by string, decided_at string, policy_version string, evidence map<string,string>, prior_value string, new_value string", ["source_cid", "property_name", "decided_by", "decided_at", "policy_version"], ("property_name", PROPERTIES), None),
    "ingest": ("cid string, source_url string, ingested_at string, policy_version string, policy_dict_sha256 string, redirect_chain array<string>, rendered_text_cid string, ingestion_metadata map<string,string>", ["cid", "ingested_at", "policy_version", "policy_dict_sha256"], None, None),
}


def _by_name(value: Column, to: T.DataType) -> Column:
    """A cast that finds the fields of structs in arrays by their names; a plain cast takes them by place."""
    if isinstance(to, T.ArrayType) and isinstance(to.elementType, T.StructType):
        return F.transform(value, lambda x: F.struct(*[x[f.name].cast(f.dataType).alias(f.name) for f in to.elementType.fields]))
    return value.cast(to)


def append_log(df: DataFrame, path: str, log: str) -> None:
    """Appends rows to a log of a known kind as JSON lines; other columns, a null where none may be, or an unknown value fail before a line is written.

    A trace's chosen chunks must be among its candidates and its context
    among the chosen, and its id must be new.
    """
    schema, needed, allowed, key = LOGS[log]
    wanted = T._parse_datatype_string(schema)
    if set(df.columns) != set(wanted.names):
        raise ValueError(f"a {log} log has the columns {wanted.names}, not {df.columns}")
    rows = df.select(*[_by_name(F.col(f.name), f.dataType).alias(f.name) for f in wanted.fields])
    bad = F.exists(F.array(*[F.col(c).isNull() for c in needed]), lambda x: x)
    if allowed:
        bad = bad | ~F.col(allowed[0]).isin(*allowed[1])
    if log == "trace":
        chosen = F.col("selected_chunks.source_cid")
        bad = bad | (F.size(F.array_except(chosen, "candidate_set")) > 0) | (F.size(F.array_except("context_window", chosen)) > 0)
    first = rows.where(F.coalesce(bad, F.lit(True))).limit(1).collect()
    if first:
        raise ValueError(f"no line for a {log} log: {first[0].asDict()}")
    if key:
        append_unique(rows, path, key)
    else:
        append_events(rows, path)


def append_events(df: DataFrame, path: str) -> None:
    """Appends rows to a log as JSON lines, fields in the order of their names and nulls written."""
    df.select(*sorted(df.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)


def append_unique(df: DataFrame, path: str, key: str) -> None:
    """Appends to a log only if no key of df stands in it yet or twice in df."""
    spark = df.sparkSession
    twice = df.groupBy(key).count().where("count > 1")
    try:
        known = spark.read.json(path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = df.limit(0).select(key)
    if not twice.isEmpty() or not df.join(known, key, "left_semi").isEmpty():
        raise ValueError(f"{key} is already in the log")
    append_events(df, path)


def lookup_one(df: DataFrame, key: str, value) -> DataFrame:
    """The one row with this key; none or several fail."""
    found = df.where(F.col(key) == value)
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{'no' if not n else 'more than one'} row with {key} = {value!r}")
    return found


def write_dataset(df: DataFrame, root: str, name: str) -> DataFrame:
    """Writes a relation as JSON files under a root; gives (path, size, sha256) of what was written."""
    target = contained(root, name)
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(target)
    return files_under(df.sparkSession, target).where(F.col("path").startswith("part-"))
