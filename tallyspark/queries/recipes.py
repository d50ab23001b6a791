"""Recipes built from the conversations."""

from pyspark.sql import functions as F

from tallyspark.operators.recipes import final_artifacts
from tallyspark.queries import query
from tallyspark.sources.tables import table


@query("""
WITH t AS (SELECT conv_id, turn, text, turn % 2 AS odd FROM conversations),
g AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE odd = 0), '') AS even, coalesce(string_agg(text, '--' ORDER BY turn) FILTER (WHERE odd = 1), '') AS odd, arg_min(text, turn) AS first FROM t GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS recipe,
  CASE WHEN conv_id % 7 = 1 THEN 'unknown input' WHEN conv_id % 7 = 2 THEN 'unsupported rule' WHEN conv_id % 7 = 3 THEN 'missing source' WHEN conv_id % 7 = 4 THEN 'not produced' ELSE 'built' END AS status,
  CASE WHEN conv_id % 7 IN (0, 5, 6) THEN sha256(odd || '|' || even || '|' || first || '|' || odd) END AS digest
FROM g
""")
def q_recipe_dag(spark, sf_dir):
    """Each conversation as a recipe of three joins, one on top of two, some broken."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("recipe"), "conv_id", "turn", "text")
    name = F.concat(F.lpad(F.col("turn").cast("string"), 9, "0"), F.lit(".txt"))
    sources = t.select("recipe", name.alias("name"), F.col("text").alias("content"))
    listed = lambda rest: F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == rest, F.concat(F.lit("sources/"), name))))
    of = t.groupBy("recipe", "conv_id").agg(listed(0).alias("even"), listed(1).alias("odd"), F.concat(F.lit("sources/"), F.min(name)).alias("first"))
    kind = F.col("conv_id") % 7
    third = F.array(F.lit("odd"), F.when(kind == 1, "final").otherwise("even"), F.when(kind == 3, "sources/none").otherwise(F.col("first")), F.lit("odd"))
    step = lambda n, rule, inputs, output, separator: F.struct(F.lit(n).alias("step"), rule.alias("rule"), inputs.alias("inputs"), output.alias("output"), F.lit(separator).cast("string").alias("separator"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("int").alias("compresslevel"))
    concat = F.lit("concat")
    steps = of.select("recipe", F.explode(F.array(step(1, concat, F.col("even"), F.lit("even"), None), step(2, F.when(kind == 2, "zip").otherwise(concat), F.col("odd"), F.lit("odd"), "--"), step(3, concat, third, F.lit("final"), "|"))).alias("s")).select("recipe", "s.*")
    return final_artifacts(steps, sources, of.select("recipe", F.when(kind == 4, "other").otherwise("final").alias("final")))
