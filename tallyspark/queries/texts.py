"""Text profiles, sentences, regular expressions, redaction."""

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import shapes
from tallyspark.queries import query
from tallyspark.sources.files import admit, cid, json_depth, parse_tolerant
from tallyspark.sources.tables import dealt, table


@query(r"""
SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '\pP', '', 'g'), '\s+', ' ', 'g')) AS normal FROM benchmark
""")
def q_norm_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalise_ascii(F.col("text")).alias("normal"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s
  FROM documents WHERE NOT regexp_matches(text, '[0-9]'))
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_segments, CAST(length(s[1]) AS BIGINT) AS first_chars FROM s
""")
def q_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike("[0-9]")).select("doc_id", T.segments(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_segments"), F.length(F.get("s", F.lit(0))).cast("long").alias("first_chars"))


@query(r"""
WITH s AS (SELECT item_id, regexp_split_to_array(regexp_replace(text, '([.!?]+\s+)', '\1' || chr(1), 'g'), chr(1)) AS s FROM benchmark WHERE NOT regexp_matches(text, '[0-9]'))
SELECT item_id, CAST(len(list_filter(s, lambda x: trim(x) <> '')) AS BIGINT) AS n_sentences,
  trim(regexp_replace(s[2], '\s+', ' ', 'g')) AS second, CAST(strlen(s[1]) AS BIGINT) AS starts_at
FROM s WHERE len(list_filter(s, lambda x: trim(x) <> '')) > 1
""")
def q_nth_sentence(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").where(~F.col("text").rlike("[0-9]")).select("item_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 1)
    second = T.nth(F.col("s"), 1)
    return items.select("item_id", F.size("s").cast("long").alias("n_sentences"), second["text"].alias("second"), second["start"].alias("starts_at"))


@query(r"""
WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])[.!?]', '\1' || chr(1), 'g'), '[.!?]([0-9])', chr(1) || '\1', 'g') AS text FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM p)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_segments, CAST(length(s[1]) AS BIGINT) AS first_chars FROM s
""")
def q_sentences_all(spark, sf_dir):
    """q_sentences over every row; the statement puts another character for marks that touch a digit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.segments(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_segments"), F.length(F.get("s", F.lit(0))).cast("long").alias("first_chars"))


@query(r"""
WITH p AS (SELECT item_id, regexp_replace(regexp_replace(regexp_replace(text, '([0-9])\.', '\1' || chr(2), 'g'), '([0-9])!', '\1' || chr(3), 'g'), '([0-9])\?', '\1' || chr(4), 'g') AS text FROM benchmark),
s AS (SELECT item_id, regexp_split_to_array(regexp_replace(text, '([.!?]+\s+)', '\1' || chr(1), 'g'), chr(1)) AS s FROM p)
SELECT item_id, CAST(len(list_filter(s, lambda x: trim(x) <> '')) AS BIGINT) AS n_sentences,
  translate(trim(regexp_replace(s[2], '\s+', ' ', 'g')), chr(2) || chr(3) || chr(4), '.!?') AS second, CAST(strlen(s[1]) AS BIGINT) AS starts_at
FROM s WHERE len(list_filter(s, lambda x: trim(x) <> '')) > 1
""")
def q_nth_sentence_all(spark, sf_dir):
    """q_nth_sentence over every row."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 1)
    second = T.nth(F.col("s"), 1)
    return items.select("item_id", F.size("s").cast("long").alias("n_sentences"), second["text"].alias("second"), second["start"].alias("starts_at"))


@query(r"""
WITH s AS (SELECT page_id, (CASE WHEN regexp_matches(html, '<script') THEN 3 ELSE 0 END) + (CASE WHEN regexp_matches(html, '<h[1-6]') THEN 2 ELSE 0 END)
  + (CASE WHEN coalesce(try_cast(regexp_extract(html, 'width="?([0-9]+)', 1) AS INTEGER) >= 100, false) THEN 2 ELSE 0 END)
  + (CASE WHEN regexp_matches(html, 'href=') THEN 1 ELSE 0 END) AS score FROM pages)
SELECT page_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 7 THEN 'TRUE_POSITIVE' WHEN score >= 3 THEN 'SUSPICIOUS' ELSE 'FALSE_POSITIVE' END AS label FROM s
""")
def q_regex_score(spark, sf_dir):
    rules = [("<script", 3, None), ("<h[1-6]", 2, None), ('width="?([0-9]+)', 2, 100), ("href=", 1, None)]
    score = F.lit(0).cast("long")
    for pattern, weight, least in rules:
        hit = F.col("html").rlike(pattern)
        if least is not None:
            hit = F.coalesce(F.regexp_extract("html", pattern, 1).try_cast("int") >= least, F.lit(False))
        score = score + F.when(hit, weight).otherwise(0)
    scored = table(spark, sf_dir, "pages").select("page_id", score.alias("score"))
    label = F.when(F.col("score") >= 7, "TRUE_POSITIVE").when(F.col("score") >= 3, "SUSPICIOUS").otherwise("FALSE_POSITIVE")
    return scored.withColumn("label", label)


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0
""")
def q_json_tolerant(spark, sf_dir):
    """Every seventh row's text is cut short first, and is skipped as no JSON."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("props"))
    return parse_tolerant(e, "props", "k BIGINT").select("event_id", "k")


@query(r"""
WITH w AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN repeat('[', 70) || repeat(']', 70) WHEN event_id % 5 = 1 THEN '{"a":"[[[","b":[[1]]}' WHEN event_id % 5 = 2 THEN repeat(props, 40) ELSE props END AS raw FROM events)
SELECT event_id, CASE WHEN strlen(raw) > 200 THEN 'too_large' WHEN event_id % 5 = 0 THEN 'too_deep' ELSE 'ok' END AS verdict,
  CAST(CASE event_id % 5 WHEN 0 THEN 70 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS depth FROM w
""")
def q_admission(spark, sf_dir):
    n = F.col("event_id") % 5
    raw = F.when(n == 0, "[" * 70 + "]" * 70).when(n == 1, '{"a":"[[[","b":[[1]]}').when(n == 2, F.repeat("props", F.lit(40))).otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", admit(F.col("raw"), 200, 64).alias("verdict"), json_depth(F.col("raw")).alias("depth"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS cid FROM documents")
def q_cid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cid(F.col("text")).alias("cid"))


@query()
def q_redact(spark, sf_dir):
    """No statement: overlapping spans are joined in order, which a test shows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    done = shapes.redact(turns, "text", {"NUMBER": r"\d{3,}", "WORD": r"\bth\w{9,}"}, ["The", "Der"])
    return done.select("conv_id", "turn", "redacted", "n_spans")


@query()
def q_viterbi(spark, sf_dir):
    """No statement: a test holds the decoder against all valid sequences. Logits come from 33 of a vector's numbers, eight vectors to a sequence."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 8).cast("long").alias("seq"), (F.col("vec_id") % 8).alias("pos"), F.transform(F.slice("embedding", 1, 33), lambda x: x.cast("double") * 8).alias("logits"))
    return shapes.decode_spans(v, "seq", "pos", "logits", [0.1, 0.0, 0.2, 0.1, -0.1, -0.2], [f"c{i}" for i in range(8)])


@query()
def q_fea(spark, sf_dir):
    """No statement: a test holds it against a bar under tension. One two-triangle plate per part, pulled by its price."""
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("load")))
    nodes = F.expr("array(array(0d, 0d), array(1d, 0d), array(1d, 1d), array(0d, 1d))")
    meshes = parts.select(
        "p_partkey", nodes.alias("nodes"), F.expr("array(array(0, 1, 2), array(0, 2, 3))").alias("elements"),
        F.expr("array(struct(0 as dof, 0d as value), struct(1 as dof, 0d as value), struct(6 as dof, 0d as value))").alias("fixed"),
        F.array(*[F.struct(F.lit(d).alias("dof"), (F.col("load") / 2).alias("value")) for d in (2, 4)]).alias("loads"),
        F.lit(1e5).alias("e"), F.lit(0.3).alias("nu"), F.lit(0.1).alias("thickness"),
    )
    return shapes.max_von_mises(meshes, "p_partkey").select("p_partkey", F.round("max_stress", 3).alias("max_stress"))


@query("""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)) ELSE text END || ' Straße ÀÉ ' || chr(12288) AS text FROM documents),
f AS (SELECT doc_id, regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\\p{P}', '', 'g') AS p FROM t)
SELECT doc_id, sha256(trim(regexp_replace(p, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g'), ' ')) AS profile_sha256 FROM f
""")
def q_text_profile(spark, sf_dir):
    """The digest of every document's exact profile, a third of them with decomposed letters."""
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, apart).otherwise(F.col("text")), F.lit(" Straße ÀÉ \u3000"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.profile(text), 256).alias("profile_sha256"))
