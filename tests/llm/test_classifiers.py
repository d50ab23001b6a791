import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm.quality import WIDTH, classify_quality, fit_ranking, text_features
from tallyspark.llm.toxicity import INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT, Lexicon, classify_toxicity, clause_scores, grammar

TEXT, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def held_out_accuracy(out, labels, label):
    rows = out.join(labels, "doc_id").where("held_out").collect()
    for r in rows:
        assert zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1
    return np.mean([r.predicted == r[label] for r in rows])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    assert held_out_accuracy(classify_quality(docs, labels), labels, "quality") > 0.97
    assert held_out_accuracy(classify_toxicity(docs, labels), labels, "toxic") > 0.97


def test_pairs_order_the_classes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 1] - x[:, 2] + 0.1 * rng.normal(size=600) > -0.8).astype(int)
    model = fit_ranking(x, y)
    strength = model.strength(x)
    assert np.mean(rng.choice(strength[y == 1], 2000) > rng.choice(strength[y == 0], 2000)) > 0.98
    assert np.mean((model.score(x) >= 0.5) == y) > 0.93
    assert set(fit_ranking(x, np.ones(600)).score(x)) == {0.5}
    assert fit_ranking(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_features_see_whole_texts():
    x = text_features(pa.array(["plain words here", None, "", "LOUD!!! LOUD!!!", "a\na\na", "z" * 3_000_000 + "!"]))
    assert x.shape == (6, WIDTH) and not x[1].any() and not x[2].any() and np.isfinite(x).all()
    assert x[3, 0] > 0 and x[5, 0] > 0


def test_grammar():
    machine = grammar()
    score = lambda *symbols: machine.run(list(symbols), [2.0] * len(symbols))
    assert score(INSULT) == 2.0
    assert score(TARGET, INSULT) > score(INSULT) > score(REPORT, INSULT) > score(NEGATION, REPORT, INSULT)
    assert score(NEGATION, INSULT) < score(NEGATION, OTHER, OTHER, OTHER, INSULT) == score(INSULT)
    assert score(TARGET, THREAT) > score(THREAT) > 0 and score(OTHER, TARGET, NEGATION) == 0
    assert score(INSULT, INSULT) > score(INSULT) and score(INSULT, INSULT) < 2 * score(INSULT)


def test_clauses_not_words():
    texts = ["You are an idiot.", "He said: you are no idiot", "An idiot", "", None, "You. Idiot", "I will kill you", "kill time", "perfectly fine text"]
    x = clause_scores(pa.array(texts), Lexicon(), grammar())[:, 0]
    assert x[0] > x[2] > x[1] > 0 and x[3] == x[4] == x[8] == 0
    assert x[5] == x[2] and x[6] > x[7]


@pytest.mark.parametrize("classify", [classify_quality, classify_toxicity])
def test_edges(spark, classify):
    docs = spark.createDataFrame([(1, "You idiot", "s"), (1, "You idiot", "s"), (2, None, None), (3, "", "x"), (None, "text", "y")], TEXT + ", score string")
    for labels in ([], [(1, None, None)], [(1, 1, 1)], [(1, 1, 1), (1, 0, 0), (2, 0, 0), (None, 1, 1), (9, 1, 0)]):
        out = classify(docs, spark.createDataFrame(labels, LABELS))
        assert out.columns == ["doc_id", "text", "score", "score_", "predicted", "held_out"]
        rows = out.collect()
        assert len(rows) == 5 and all(0 <= r.score_ <= 1 for r in rows)
    assert classify(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    from pyspark.sql import functions as F

    from tallyspark.llm._labels import held_out

    lied = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)).cast("int") for c in ("quality", "toxic")})
    for classify in (classify_quality, classify_toxicity):
        a, b = (classify(docs, x).select("doc_id", "score").toPandas().set_index("doc_id").score for x in (labels, lied))
        assert (a - b).abs().max() == 0
