"""Rule, tier, validity, keyword and reconciliation joins."""

from pyspark.sql import functions as F

from tallyspark.functions.numbers import cents, half_up, hash_unit, logistic
from tallyspark.functions.text import fold_ascii, holds
from tallyspark.operators import rules as R
from tallyspark.queries import query
from tallyspark.sources.tables import table

#: Fixed rules, the same literals in the statements below.
RULES = [
    ("r1", [("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("o_totalprice", ">", 200000.0)], "review"),
    ("r2", [("o_orderstatus", "eq", "F"), ("o_totalprice", "<", 20000.0)], "close"),
    ("r3", [("o_totalprice", ">=", 400000.0)], "escalate"),
]


@query("""
SELECT o_orderkey, 'r1' AS rule_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 200000 THEN 'review' ELSE 'NOT_APPLICABLE' END AS verdict FROM orders
UNION ALL SELECT o_orderkey, 'r2', CASE WHEN o_orderstatus = 'F' AND o_totalprice < 20000 THEN 'close' ELSE 'NOT_APPLICABLE' END FROM orders
UNION ALL SELECT o_orderkey, 'r3', CASE WHEN o_totalprice >= 400000 THEN 'escalate' ELSE 'NOT_APPLICABLE' END FROM orders
""")
def q_policy_matrix(spark, sf_dir):
    return R.policy_matrix(table(spark, sf_dir, "orders"), RULES).select("o_orderkey", "rule_id", "verdict")


@query("""
SELECT o_orderkey,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 200000 THEN 'r1' WHEN o_orderstatus = 'F' AND o_totalprice < 20000 THEN 'r2' WHEN o_totalprice >= 400000 THEN 'r3' END AS rule_id,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 200000 THEN 'review' WHEN o_orderstatus = 'F' AND o_totalprice < 20000 THEN 'close' WHEN o_totalprice >= 400000 THEN 'escalate' ELSE 'clear' END AS verdict
FROM orders
""")
def q_first_match(spark, sf_dir):
    return R.first_match(table(spark, sf_dir, "orders"), RULES, "clear").select("o_orderkey", "rule_id", "verdict")


NEEDS = [("all_kinds", "click"), ("all_kinds", "view"), ("all_kinds", "purchase"), ("buyer", "purchase"), ("impossible", "purchase"), ("impossible", "none")]


@query("""
WITH r(rule, item) AS (VALUES ('all_kinds', 'click'), ('all_kinds', 'view'), ('all_kinds', 'purchase'), ('buyer', 'purchase'), ('impossible', 'purchase'), ('impossible', 'none')),
n AS (SELECT rule, count(*) AS n FROM r GROUP BY 1)
SELECT user_id, rule FROM (SELECT user_id, rule, count(DISTINCT item) AS m FROM events JOIN r ON event_type = item GROUP BY 1, 2) JOIN n USING (rule) WHERE m = n
""")
def q_rule_division(spark, sf_dir):
    facts = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("item"))
    return R.division(facts, spark.createDataFrame(NEEDS, "rule string, item string"), ["user_id"], "item", "rule")


TIERS = [(0.0, 0.3, "low"), (0.3, 0.5, "middle"), (0.5, 0.9, "high"), (0.9, 1.0, "top")]


@query("""
WITH p AS (SELECT c_custkey, 1 / (1 + exp(-(-1.5::DOUBLE + c_acctbal * 0.0004::DOUBLE + c_nationkey * 0.01::DOUBLE))) AS pd FROM customer)
SELECT c_custkey, round(pd, 9) AS pd, CASE WHEN pd >= 0 AND pd < 0.3 THEN 'low' WHEN pd >= 0.3 AND pd < 0.5 THEN 'middle' WHEN pd >= 0.5 AND pd < 0.9 THEN 'high' ELSE 'top' END AS tier FROM p
""")
def q_score_tiers(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").select("c_custkey", logistic({"c_acctbal": 0.0004, "c_nationkey": 0.01}, -1.5).alias("pd"))
    return scored.select("c_custkey", F.round("pd", 9).alias("pd"), R.tier(F.col("pd"), TIERS).alias("tier"))


EDITIONS = [(1, "first", "1990-01-01 00:00:00", "1994-07-01 00:00:00"), (2, "second", "1994-01-01 00:00:00", "1997-01-01 00:00:00"), (3, "third", "1997-01-01 00:00:00", None)]


@query("""
WITH i(ordinal, edition, s, e) AS (VALUES (1, 'first', TIMESTAMP '1990-01-01', TIMESTAMP '1994-07-01'), (2, 'second', TIMESTAMP '1994-01-01', TIMESTAMP '1997-01-01'), (3, 'third', TIMESTAMP '1997-01-01', NULL)),
m AS (SELECT o_orderkey, o_orderpriority, edition, row_number() OVER (PARTITION BY o_orderkey ORDER BY ordinal) AS n FROM orders JOIN i ON s <= o_orderdate AND (e IS NULL OR o_orderdate < e))
SELECT o_orderkey, edition, o_orderpriority IN ('1-URGENT', '3-MEDIUM') AS listed FROM m WHERE n = 1
""")
def q_validity_join(spark, sf_dir):
    intervals = spark.createDataFrame(EDITIONS, "ordinal int, edition string, start string, end string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    words = spark.createDataFrame([("1-URGENT",), ("3-MEDIUM",)], "word string")
    listed = R.valid_at(orders, "ts", intervals).join(F.broadcast(words.withColumn("listed", F.lit(True))), F.col("o_orderpriority") == F.col("word"), "left")
    return listed.select("o_orderkey", "edition", F.coalesce("listed", F.lit(False)).alias("listed"))


def _words(df, key):
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))).alias("word"))


@query("""
WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS word FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS word FROM benchmark),
p AS (SELECT item_id, doc_id, count(*) AS overlap FROM b JOIN d USING (word) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM p)
SELECT item_id, doc_id, overlap, rank FROM r WHERE rank <= 5
""")
def q_keyword_overlap(spark, sf_dir):
    items, docs = _words(table(spark, sf_dir, "benchmark"), "item_id"), _words(table(spark, sf_dir, "documents"), "doc_id")
    return R.best_overlaps(R.keyword_overlap(items, docs, "item_id", "doc_id", "word"), "item_id", "doc_id", 5)


@query("""
SELECT item_id, count(d.doc_id) AS n_docs, count(d.doc_id) > 0 AS rooted
FROM benchmark b LEFT JOIN documents d ON length(b.text) > 0 AND contains(lower(d.text), lower(b.text)) GROUP BY 1
""")
def q_citation_gate(spark, sf_dir):
    """Which items stand in a document, word for word."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("quote"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("whole"))
    counts = R.quoted(items, docs, "item_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.col("n_docs").isNotNull().alias("rooted"))


@query("""
SELECT b.item_id, d.doc_id, CASE WHEN d.doc_id IS NULL THEN 'UNRESOLVED' WHEN length(trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g'))) > 0
  AND contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g'))) THEN 'ROOTED' ELSE 'NOT_FOUND' END AS status
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 30
""")
def q_quote_check(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), (F.col("item_id") * 30).alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = R.resolve(items, docs.join(items.select("doc_id"), "doc_id", "left_semi"), "doc_id", ["text"])
    status = F.when(~F.col("resolved"), "UNRESOLVED").when(holds(fold_ascii(F.col("text")), fold_ascii(F.col("quote"))), "ROOTED").otherwise("NOT_FOUND")
    return found.select("item_id", F.when(F.col("resolved"), F.col("doc_id")).alias("doc_id"), status.alias("status"))


@query("""
WITH l AS (SELECT l_orderkey, CAST(sum((CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) + 50) // 100) AS BIGINT) AS net FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS issued_cents, net AS computed_cents, CASE WHEN net IS NULL THEN 'NO_LINES' WHEN abs(net - CAST(round(o_totalprice * 100) AS BIGINT)) <= 100 THEN 'MATCH' ELSE 'DIFFERS' END AS status
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def q_reconcile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    net = half_up(cents(F.col("l_extendedprice")) * (100 - F.round(F.col("l_discount") * 100).cast("long")), 100)
    sums = lines.groupBy("l_orderkey").agg(F.sum(net).alias("computed_cents"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("issued_cents"))
    joined = orders.join(sums, orders["o_orderkey"] == sums["l_orderkey"], "left")
    status = F.when(F.col("computed_cents").isNull(), "NO_LINES").when(F.abs(F.col("computed_cents") - F.col("issued_cents")) <= 100, "MATCH").otherwise("DIFFERS")
    return joined.select("o_orderkey", "issued_cents", "computed_cents", status.alias("status"))


@query("""
WITH c AS (SELECT s_suppkey, p_brand, s_acctbal / 25 + p.size AS mw, p.size / 10.0::DOUBLE AS logp, s_suppkey || '-' || p_brand AS id
  FROM supplier CROSS JOIN (SELECT p_brand, max(p_size) AS size FROM part GROUP BY 1) p),
s AS (SELECT *, (CAST('0x' || substr(sha256(id || '|7'), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616::DOUBLE) AS u,
  CASE WHEN mw > 300 THEN 'rejected:mw' WHEN logp > 5.5 THEN 'rejected:logp' ELSE 'passed' END AS status FROM c)
SELECT id, round(-12 + u * 8 + 0.3::DOUBLE * (-(mw / 500) * 0.5 - (logp / 5) * 0.5), 6) AS score FROM s WHERE status = 'passed' ORDER BY score, id LIMIT 20
""")
def q_combi_topk(spark, sf_dir):
    """Every supplier with every brand (a few), scored; the 20 best are the result."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").alias("size"))
    pairs = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(brands))
    made = pairs.select(F.concat_ws("-", F.col("s_suppkey").cast("string"), "p_brand").alias("id"), (F.col("s_acctbal") / 25 + F.col("size")).alias("mw"), (F.col("size") / 10.0).alias("logp"))
    passed = made.where((F.col("mw") <= 300) & (F.col("logp") <= 5.5))
    score = -12 + hash_unit(F.concat("id", F.lit("|7"))) * 8 + 0.3 * (-(F.col("mw") / 500) * 0.5 - (F.col("logp") / 5) * 0.5)
    return passed.select("id", F.round(score, 6).alias("score")).orderBy("score", "id").limit(20)


@query("""
WITH f(feature_id, kind, x, y) AS (VALUES ('a', 0, 1.0, 2.0), ('b', 1, 4.0, 6.0), ('c', 2, 9.0, 1.0)),
m AS (SELECT p_partkey, feature_id, (CAST(p_size AS DOUBLE) - x) * (p_size - x) + (p_retailprice / 100 - y) * (p_retailprice / 100 - y) AS d2
  FROM part JOIN f ON p_size % 3 = kind OR kind = 0)
SELECT p_partkey, count(*) AS n_features, round(sqrt(avg(d2)), 6) AS rmsd FROM m GROUP BY 1
""")
def q_feature_fit(spark, sf_dir):
    """Each part's mapped features against a literal template: two look-ups, then root mean square of distances."""
    template = F.map_from_arrays(F.array(*[F.lit(x) for x in "abc"]), F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 2.0), (4.0, 6.0), (9.0, 1.0))]))
    mapped = F.when(F.col("p_size") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).when(F.col("p_size") % 3 == 2, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("px"), (F.col("p_retailprice") / 100).alias("py"), F.explode(mapped).alias("feature_id"))
    at = template[F.col("feature_id")]
    d2 = (F.col("px") - at["x"]) * (F.col("px") - at["x"]) + (F.col("py") - at["y"]) * (F.col("py") - at["y"])
    return rows.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sqrt(F.avg(d2)), 6).alias("rmsd"))
