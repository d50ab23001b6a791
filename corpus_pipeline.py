"""From raw documents to packed training sequences, as five stages over whole tables.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm._common import columns_free_of, shared_folder, table
from tallyspark.llm.decontamination import decontaminate
from tallyspark.llm.line_dedup import dedup_lines
from tallyspark.llm.ngram_join import similar_sets
from tallyspark.llm.packing import best_fit_packing
from tallyspark.llm.quality import learn_quality, score_quality

#: Removed ids (8 bytes each) that are broadcast at most; more are joined.
REMOVED_IDS = 2_000_000
#: Rows that a Python worker gets at a time: whole texts, so that few are in memory at once.
BATCH = "1000"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality ranking, taught by labels, predicts as 0.

    A null or empty text has a score like any other and goes or stays by it;
    rows that repeat are judged alike; without labels, or with those of one
    class only, the model decides as learn_quality says. An empty table gives
    no rows; all columns stay as they are, whatever their names.
    """
    _small_batches(spark)
    columns = docs.columns
    (predicted,) = columns_free_of(docs, "predicted")
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where(F.col(predicted) == 1).select(*columns)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of texts; a document of which nothing but blank or bare lines is left goes.

    Texts in which nothing repeats, null and empty ones stay as they are;
    n_chars, if there is such a column, follows the text. The rest is as
    dedup_lines says; all columns stay, whatever their names.
    """
    _small_batches(spark)
    columns = docs.columns
    removed = columns_free_of(docs, "n_lines", "n_removed")[1]
    done = dedup_lines(docs, percent=80)
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    left = done.where(~((F.col(removed) > 0) & empty))
    if "n_chars" in columns:
        left = left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8) and all that link with nothing.

    Rows that repeat a doc_id and its text are one document and stay once;
    other texts of one doc_id are documents of their own. Rows without a
    doc_id stay.
    """
    _small_batches(spark)
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _near_duplicates_of_reused_ids(docs)
    joined = similar_sets(docs, n=5, percent=80)
    gone = joined.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(_small(gone), "doc_id", "left_anti").select(*docs.columns)


def _near_duplicates_of_reused_ids(docs: DataFrame) -> DataFrame:
    """The filter with doc_id and text hash as the id; one without a doc_id comes last."""
    (own,) = columns_free_of(docs, "_own")
    keyed = docs.withColumn(own, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("version")))
    joined = similar_sets(keyed.select(F.col(own).alias("doc_id"), "text"), n=5, percent=80)
    gone = joined.where("not doc_id.none and doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    kept = keyed.join(_small(gone), own, "left_anti")
    once = kept.where("doc_id is not null").dropDuplicates([own])
    return kept.where("doc_id is null").unionByName(once).select(*docs.columns)


def _small(ids: DataFrame) -> DataFrame:
    """Marks ids for a broadcast while they are few."""
    return F.broadcast(ids) if ids.limit(REMOVED_IDS + 1).count() <= REMOVED_IDS else ids


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window (or a whole shorter item) of the benchmark.

    A null or wordless text holds none and stays, as does all else where the
    benchmark is empty; rows that repeat are judged alike; all columns stay.
    """
    _small_batches(spark)
    spans = columns_free_of(docs, "hit_spans")[0]
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10).where(F.size(spans) == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece of a document, with its place.

    A null text is packed as an empty one, rows that repeat are packed each,
    an empty table gives no rows; see best_fit_packing.
    """
    _small_batches(spark)
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), room=2048)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("benchmark decontamination", benchmark_filter),
    ("best-fit packing", packing),
]

#: No SQL: the classifier is learned and keys of hashes find lines; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
