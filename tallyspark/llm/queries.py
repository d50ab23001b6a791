"""The operators bound to the driver's tables, with the columns their contracts name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm._common import table
from tallyspark.llm.chat import fold_events, read_back, render, streamed_log
from tallyspark.llm.decontamination import decontaminate
from tallyspark.llm.hard_negatives import hard_negatives
from tallyspark.llm.line_dedup import dedup_lines
from tallyspark.llm.neighbours import nearest_neighbours
from tallyspark.llm.ngram_join import similar_sets
from tallyspark.llm.packing import best_fit_packing
from tallyspark.llm.pseudonyms import pseudonymise
from tallyspark.llm.quality import classify_quality
from tallyspark.llm.sharding import ring_shards
from tallyspark.llm.structure_repair import damage, repair
from tallyspark.llm.toxicity import classify_toxicity
from tallyspark.llm.url_templates import filter_urls


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = ring_shards(docs, shards=16)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return placed.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), room=2048)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    digest = F.sha2(F.array_join("hit_items", ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="tallyspark")
    return done.select("doc_id", "text", F.size("pii").alias("n_replaced"), "pii")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80)


def op6_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, k=5)


def op7_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.7).select("doc_id", "held_out", "score", "predicted")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = similar_sets(table(spark, sf_dir, "documents"), n=3, percent=90)
    return joined.select("doc_id", "n_shingles", "component_id")


#: The conversation every formatting run carries besides the table's own: control strings as its texts.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    read = read_back(render(fold_events(streamed_log(rows))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The rules of the URL query, as fixed values: host, begin of the path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the labels row of its number: bad, if of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op12_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


QUERIES = {f.__name__: f for f in (op1_ring_shards, op2_best_fit_packing, op3_decontaminate, op4_feistel_pseudonyms, op5_line_dedup, op6_hnsw_neighbours, op7_quality_pairs, op8_chat_events, op9_ngram_join, op10_toxicity_grammar, op11_url_templates, op12_rtree_negatives, op13_structure_repair)}
