"""Nested JSON built from the tables: admission and canonical text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.nested import admit_nested, canonical
from tallyspark.queries import query
from tallyspark.sources.tables import table, tasks


@query(r"""
WITH c AS (
  SELECT conv_id, json_object('conv', conv_id, 'turns', to_json(list(json_object('turn', turn, 'said', json_array(role, json_object('text', text, 'size', length(text)))) ORDER BY turn, role, text))) AS j
  FROM conversations GROUP BY conv_id),
t AS (SELECT c.conv_id, e.id, e.type, e.fullkey, CASE e.type WHEN 'OBJECT' THEN len(json_keys(e.value)) WHEN 'ARRAY' THEN json_array_length(e.value) ELSE 0 END AS n FROM c, json_tree(c.j) e),
b AS (SELECT conv_id, max(CASE WHEN n > 6 THEN n END) AS many, count(*) AS nodes FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN many IS NOT NULL THEN 'too_many' WHEN conv_id % 5 = 0 THEN 'not_finite' ELSE 'ok' END AS verdict,
  CASE WHEN many IS NOT NULL THEN '/turns' WHEN conv_id % 5 = 0 THEN '/worth' END AS path,
  CAST(CASE WHEN many IS NOT NULL THEN many WHEN conv_id % 5 = 0 THEN 1 ELSE nodes + 1 END AS BIGINT) AS found
FROM b
""")
def q_nested_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one nested document: at most six turns, and a worth that must be finite."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.struct(F.col("turn"), F.col("role").alias("said"), F.struct("text", F.length("text").alias("size")).alias("what"))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    entry = F.transform("turns", lambda t: F.concat(F.lit('{"turn":'), t["turn"].cast("string"), F.lit(',"said":["'), t["said"], F.lit('",'), F.to_json(t["what"]), F.lit("]}")))
    worth = F.when(F.col("conv_id") % 5 == 0, "-Infinity").otherwise("1.5e3")
    raw = F.concat(F.lit('{"conv":'), F.col("conv_id").cast("string"), F.lit(',"worth":'), worth, F.lit(',"turns":['), F.array_join(entry, ","), F.lit("]}"))
    return admit_nested(turns.select("conv_id", raw.alias("raw")), "conv_id", "raw", max_entries=6)


@query(r"""
WITH p AS (SELECT lineitem.*, '{"flag":"' || l_returnflag || '","part":' || l_partkey || ',"price":[' || CAST(l_extendedprice AS VARCHAR) || ',' || CAST(l_extendedprice * 1e12 AS VARCHAR) || ',' || CAST(l_extendedprice / 1e9 AS VARCHAR) || '],"rates":{"discount":' || CAST(l_discount AS VARCHAR) || ',"tax":' || CAST(l_tax AS VARCHAR) || '}}' AS line FROM lineitem),
o AS (SELECT l_orderkey, '[' || string_agg(line, ',' ORDER BY l_linenumber, l_returnflag, l_partkey, l_extendedprice, l_discount, l_tax) || ']' AS lines FROM p GROUP BY l_orderkey)
SELECT o_orderkey, '{"1st":true,"key":' || o_orderkey || ',"lines":' || coalesce(lines, '[]') || ',"none":null,"total":' || CAST(o_totalprice AS VARCHAR) || ',"é":"' || o_orderpriority || '"}' AS canonical
FROM orders LEFT JOIN o ON l_orderkey = o_orderkey
""")
def q_canonical_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one nested document, written loosely with its keys out of order, in canonical text."""
    # Both sides are dealt by key to all tasks: writing a document takes long for its few bytes. Documents of lines are never broadcast.
    parts = tasks(spark)
    lines = table(spark, sf_dir, "lineitem").repartition(parts, "l_orderkey")
    price = F.array("l_extendedprice", F.col("l_extendedprice") * 1e12, F.col("l_extendedprice") / 1e9)
    line = F.to_json(F.struct(F.struct(F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount")).alias("rates"), price.alias("price"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")))
    of = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey", "l_extendedprice", "l_discount", "l_tax", line.alias("line")))).alias("lines"))
    joined = table(spark, sf_dir, "orders").repartition(parts, "o_orderkey").join(of.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    listed = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), " ,\n "), F.lit(""))
    raw = F.concat(F.lit('{ "total" : '), F.col("o_totalprice").cast("string"), F.lit(', "none": null, "\\u00e9": "'), F.col("o_orderpriority"), F.lit('",\n"lines": ['), listed, F.lit('], "key": '), F.col("o_orderkey").cast("string"), F.lit(', "1st": true}'))
    return canonical(joined.select("o_orderkey", raw.alias("raw")), "o_orderkey", "raw")
