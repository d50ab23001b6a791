"""Build recipes: steps that join or compress sources and each other's outputs, run level by level over all recipes at once."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.sources.lineage import cut

#: What a name in the sources begins with.
SOURCES = "sources/"
_SCHEMA = "recipe string, step int, content binary"


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            out = io.BytesIO()
            with gzip.GzipFile(fileobj=out, mode="wb", mtime=r["mtime"], compresslevel=r["compresslevel"]) as z:
                z.write(r["content"])
            yield pa.RecordBatch.from_arrays([pa.array([r["recipe"]]), pa.array([r["step"]], pa.int32()), pa.array([out.getvalue()], pa.binary())], ["recipe", "step", "content"])


def run_recipes(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """(recipe, step, output, status, content) of every step; content is null where status isn't built.

    steps: recipe, step (their order), rule, inputs (array of names), output,
    separator, mtime, compresslevel; null options are a line feed, 0 and 6.
    sources: recipe, name, content (binary or text). An input is a source
    (sources/...) or the output of the last earlier step of that name. concat
    joins its inputs by the separator, gzip compresses its only one.

    A recipe stops at its first faulty step: that one says why (no output,
    unsupported rule, one input expected, missing source, unknown input), all
    after it say not reached. A later output as input is unknown, so there
    are no cycles. Every round builds the steps whose inputs are there, so
    there are as many rounds as the longest chain has steps.
    """
    given = steps.select(F.col("recipe").cast("string").alias("recipe"), F.col("step").cast("int").alias("step"), "rule", F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"), "output", F.coalesce("separator", F.lit("\n")).alias("separator"), F.coalesce("mtime", F.lit(0)).cast("long").alias("mtime"), F.coalesce("compresslevel", F.lit(6)).cast("int").alias("compresslevel"))
    given = cut(given)
    held = sources.select(F.col("recipe").cast("string").alias("of"), F.concat(F.lit(SOURCES), "name").alias("source"), F.col("content").cast("binary").alias("content"))
    wanted = given.select("recipe", "step", F.posexplode("inputs").alias("at", "name"))
    made = given.select(F.col("recipe").alias("of"), F.col("output").alias("made"), F.col("step").alias("maker")).where("made IS NOT NULL")
    is_source = F.coalesce(F.col("name").startswith(SOURCES), F.lit(False))
    from_steps = wanted.where(~is_source).join(made, (F.col("recipe") == F.col("of")) & (F.col("name") == F.col("made")) & (F.col("maker") < F.col("step")), "left")
    from_steps = from_steps.groupBy("recipe", "step", "at").agg(F.max("maker").alias("maker"))
    from_sources = wanted.where(is_source).join(held.select("of", "source", F.lit(True).alias("there")), (F.col("recipe") == F.col("of")) & (F.col("name") == F.col("source")), "left").select("recipe", "step", "at", "name", "there")
    lacking = from_steps.where("maker IS NULL").select("recipe", "step", F.lit("unknown input").alias("why")).unionByName(from_sources.where("there IS NULL").select("recipe", "step", F.lit("missing source").alias("why"))).groupBy("recipe", "step").agg(F.min("why").alias("why"))

    n = F.size("inputs")
    own = F.when(F.coalesce(F.col("output"), F.lit("")) == "", "no output").when(~F.coalesce(F.col("rule").isin("concat", "gzip"), F.lit(False)), "unsupported rule").when((F.col("rule") == "gzip") & (n != 1), "one input expected")
    judged = given.join(lacking, ["recipe", "step"], "left").withColumn("fault", F.coalesce(own, "why"))
    first = F.min(F.when(F.col("fault").isNotNull(), F.col("step"))).over(W.partitionBy("recipe"))
    judged = cut(judged.withColumn("stops", first).withColumn("status", F.when(F.col("step") == F.col("stops"), F.col("fault")).when(F.col("step") > F.col("stops"), "not reached").otherwise("built")).drop("why", "fault", "stops"))

    todo = judged.where("status = 'built'").select("recipe", "step")
    uses = cut(from_steps.join(todo, ["recipe", "step"], "left_semi"))
    read = cut(from_sources.join(todo, ["recipe", "step"], "left_semi").join(held, (F.col("recipe") == F.col("of")) & (F.col("name") == F.col("source"))).select("recipe", "step", "at", "content"))
    done = None
    while True:
        waits = uses if done is None else uses.join(done.select("recipe", F.col("step").alias("maker")), ["recipe", "maker"], "left_anti")
        ready = todo if done is None else todo.join(done, ["recipe", "step"], "left_anti")
        ready = ready.join(waits, ["recipe", "step"], "left_anti")
        parts = read
        if done is not None:
            parts = parts.unionByName(uses.join(done.select("recipe", F.col("step").alias("maker"), "content"), ["recipe", "maker"]).select("recipe", "step", "at", "content"))
        parts = parts.join(ready, ["recipe", "step"], "left_semi").groupBy("recipe", "step").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("parts"))
        begun = judged.join(ready, ["recipe", "step"], "left_semi").join(parts, ["recipe", "step"], "left")
        # Bytes are joined as hex digits: their concatenation then is one array_join.
        pieces = F.transform(F.coalesce("parts", F.array().cast("array<struct<at:int,content:binary>>")), lambda p: F.hex(p["content"]))
        joined = F.unhex(F.call_function("array_join", pieces, F.when(F.col("rule") == "concat", F.hex("separator")).otherwise("")))
        begun = begun.withColumn("content", joined)
        plain = begun.where("rule = 'concat'").select("recipe", "step", "content")
        built = cut(plain.unionByName(begun.where("rule = 'gzip'").select("recipe", "step", "content", "mtime", "compresslevel").mapInArrow(_compress, _SCHEMA)))
        if built.isEmpty():
            break
        done = built if done is None else cut(done.unionByName(built))
    if done is None:
        return judged.select("recipe", "step", "output", "status", F.lit(None).cast("binary").alias("content"))
    return judged.join(done, ["recipe", "step"], "left").select("recipe", "step", "output", "status", "content")


def final_artifacts(steps: DataFrame, sources: DataFrame, finals: DataFrame) -> DataFrame:
    """(recipe, status, digest) of each recipe's final artifact; finals: recipe, final. The status of its first faulty step, or not produced, stands instead of a digest."""
    ran = cut(run_recipes(steps, sources))
    fault = ran.where("status NOT IN ('built', 'not reached')").select("recipe", F.col("status").alias("fault"))
    last = ran.where("status = 'built'").groupBy("recipe", "output").agg(F.max_by("content", "step").alias("content"))
    of = finals.select(F.col("recipe").cast("string").alias("recipe"), F.col("final").alias("output"))
    joined = of.join(last, ["recipe", "output"], "left").join(fault, "recipe", "left")
    status = F.coalesce("fault", F.when(F.col("content").isNull(), "not produced"), F.lit("built"))
    return joined.select("recipe", status.alias("status"), F.when(status == "built", F.sha2("content", 256)).alias("digest"))
