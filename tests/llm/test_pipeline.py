import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyspark.llm.decontamination import decontaminate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave at the smallest size."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, folder = [docs], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs)
    return seen


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    for frame in stages[1:5]:
        assert frame.columns == stages[0].columns and frame.dtypes == stages[0].dtypes
    counts = [f.count() for f in stages]
    assert counts[0] > counts[1] > counts[4] > 0.5 * counts[0]


def test_quality_keeps_good_rows(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].select("doc_id").join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert kept > labels.agg(F.avg("quality")).first()[0]


def test_lines_stand_once(stages):
    lines = stages[2].select(F.explode(F.split("text", "\n")).alias("l")).where("l rlike '[A-Za-z]'")
    assert lines.count() == lines.distinct().count()
    assert stages[2].where("n_chars <> length(text)").count() == stages[1].where("n_chars <> length(text)").count()


def test_near_duplicates_go(stages):
    from tests.llm.test_ngram_join import brute

    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    kept = {r.doc_id for r in stages[3].collect()}
    assert kept == {d for d, _, c in brute(rows, 5, 80) if d == c}


def test_benchmark_goes(spark, stages):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate(stages[3], bench).where(F.size("hit_spans") > 0).collect()}
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()} - hit


def test_run(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = P.run(spark, SF).select(*key).toPandas().sort_values(key).reset_index(drop=True)
    assert got.equals(stages[5].select(*key).toPandas().sort_values(key).reset_index(drop=True))


def test_near_duplicates_of_a_reused_id(spark):
    """Of two texts of id 5 one is a copy of id 1; the other stays."""
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    rows = spark.createDataFrame([(1, one), (5, one), (5, two), (5, two), (None, one), (6, None)], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in P.near_duplicate_filter(spark, rows, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, one), (5, two), (None, one), (6, None)], key=str)


def test_stages_take_hard_rows(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, "alone " * 9, "en", "s", 1), (2, None, None, None, None), (3, "", "", "", 0), (4, text + " more", "en", "s", 5)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        docs = frame
        for k, (_, stage) in enumerate(P.STAGES):
            out = f"{tmp_path}/{k}-{frame is docs}-{id(frame)}"
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
    near = P.near_duplicate_filter(spark, spark.createDataFrame(rows, kinds), str(tmp_path))
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "2", "3", "None"]
