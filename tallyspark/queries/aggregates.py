"""Grouped aggregates, releases, quality and fairness figures."""

from pyspark.sql import functions as F

from tallyspark.functions.numbers import cascade, cents, clip
from tallyspark.operators import aggregates as A
from tallyspark.plans.tabular import aggregate, result_digest
from tallyspark.queries import query
from tallyspark.sources.tables import table

SPEC = {
    "table": "lineitem",
    "select": [
        {"kind": "column", "name": "l_returnflag"},
        {"kind": "column", "name": "l_linestatus"},
        {"kind": "agg", "func": "sum", "column": "l_linenumber", "alias": "sum_linenumber"},
        {"kind": "agg", "func": "count", "column": "*", "alias": "n"},
    ],
    "group_by": ["l_returnflag", "l_linestatus"],
    "order_by": ["l_returnflag", "l_linestatus"],
}


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS sum_linenumber, count(*) AS n
FROM lineitem GROUP BY 1, 2 ORDER BY CAST(l_returnflag AS VARCHAR), CAST(l_linestatus AS VARCHAR)
""")
def q_tabular_groupby(spark, sf_dir):
    return aggregate(table(spark, sf_dir, "lineitem"), SPEC)


@query("""
WITH r AS (SELECT l_returnflag AS a, l_linestatus AS b, sum(l_linenumber) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT sha256('l_returnflag,l_linestatus,sum_linenumber,n' || chr(10) || string_agg(a || ',' || b || ',' || s || ',' || n, chr(10) ORDER BY a, b)) AS result_sha FROM r
""")
def q_tabular_result_sha(spark, sf_dir):
    return result_digest(table(spark, sf_dir, "lineitem"), SPEC)


PREDICATE = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def q_filtered_count(spark, sf_dir):
    return A.filtered_count(table(spark, sf_dir, "orders"), PREDICATE)


NOISE = A.laplace_noise(1.0 / 0.5, 42)


@query(f"""
SELECT count(*) AS true_count, CAST(count(*) AS DOUBLE) + CAST({NOISE!r} AS DOUBLE) AS noised_count
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
""")
def q_dp_count(spark, sf_dir):
    return A.private_count(table(spark, sf_dir, "orders"), PREDICATE, epsilon=0.5, sensitivity=1.0, seed=42)


def _features(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", cents(F.col("o_totalprice")).alias("c"), "o_orderpriority", "o_orderstatus")
    per = orders.groupBy("o_custkey").agg(F.sum("c").alias("total_cents"), F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))
    return per.select(F.col("o_custkey").alias("c_custkey"), "total_cents", "n_orders", F.when(F.col("n_orders") > 0, F.col("n_urgent") / F.col("n_orders")).otherwise(0.0).alias("urgent_share"), F.when(F.col("n_orders") > 0, F.col("n_final") / F.col("n_orders")).otherwise(0.0).alias("final_share"), (F.col("n_orders") * 365.25 / 7).alias("annual_orders"))


_FEATURES = """
SELECT o_custkey AS c_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents, count(*) AS n_orders,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) AS urgent_share,
  count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS final_share,
  CAST(count(*) AS DOUBLE) * CAST(365.25 AS DOUBLE) / CAST(7 AS DOUBLE) AS annual_orders
FROM orders GROUP BY o_custkey
"""


@query(_FEATURES)
def q_entity_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query(f"""
SELECT c_custkey, CASE WHEN urgent_share > 0.4 OR final_share > 0.9 THEN 'surcharge' WHEN annual_orders <= 300 THEN 'low_volume' ELSE 'standard' END AS tier
FROM ({_FEATURES})
""")
def q_tier_classify(spark, sf_dir):
    f = _features(spark, sf_dir)
    tier = cascade(((F.col("urgent_share") > 0.4) | (F.col("final_share") > 0.9), "surcharge"), (F.col("annual_orders") <= 300, "low_volume"), otherwise="standard")
    return f.select("c_custkey", tier.alias("tier"))


@query("""
SELECT CAST(sum(c * d) AS BIGINT) AS total_parts
FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem)
""")
def q_weighted_total(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.round("l_extendedprice", 2).cast("decimal(14,2)").alias("p"), F.round("l_discount", 2).cast("decimal(6,2)").alias("d"))
    total = A.rounded_total(rows, F.col("p"), F.col("d"), "total")
    return total.select((F.col("total") * 10_000).cast("long").alias("total_parts"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) AS attributed_parts FROM lineitem
""")
def q_attribution(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (cents(F.col("l_extendedprice")) * F.round(F.col("l_discount") * 100).cast("long")).alias("attributed_parts"))


@query("""
WITH m AS (
  SELECT 'quantity' AS measure, CAST(round(l_quantity * 100) AS BIGINT) AS v FROM lineitem
  UNION ALL SELECT 'price', CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'discount', CAST(round(l_discount * 100) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'tax', CAST(round(l_tax * 100) AS BIGINT) FROM lineitem),
t AS (SELECT measure, CAST(sum(v) AS BIGINT) AS total, CASE WHEN sum(v) > 10000000 THEN 3 WHEN sum(v) > 100000 THEN 2 ELSE 1 END AS class FROM m GROUP BY 1)
SELECT measure, total, class, max(class) OVER () AS worst FROM t
""")
def q_unpivot_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[F.round(F.col(f"l_{c}") * 100).cast("long").alias(n) for c, n in (("quantity", "quantity"), ("extendedprice", "price"), ("discount", "discount"), ("tax", "tax"))])
    sums = rows.agg(*[F.sum(c).alias(c) for c in rows.columns])
    long = sums.unpivot([], rows.columns, "measure", "total")
    classed = long.withColumn("class", cascade((F.col("total") > 10_000_000, 3), (F.col("total") > 100_000, 2), otherwise=1))
    worst = classed.agg(F.max("class").alias("worst"))
    return classed.crossJoin(F.broadcast(worst)).select("measure", "total", "class", "worst")


def _labelled(spark, sf_dir, how="left"):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", how)


@query("SELECT 100.0::DOUBLE * count(*) FILTER (WHERE lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL) / count(*) AS completeness_pct FROM documents LEFT JOIN labels USING (doc_id)")
def q_completeness(spark, sf_dir):
    return A.completeness(_labelled(spark, sf_dir), ["lang", "quality", "toxic"])


@query("""
SELECT 100.0::DOUBLE * (count(*) - count(DISTINCT text)) / count(*) AS duplicate_pct, count(*) AS n FROM documents
""")
def q_duplicate_rate(spark, sf_dir):
    return A.duplicate_rate(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), ["digest"])


@query("SELECT 100.0::DOUBLE * count(*) FILTER (WHERE quality = 1) / count(quality) AS positive_pct FROM documents LEFT JOIN labels USING (doc_id)")
def q_positive_rate(spark, sf_dir):
    return A.positive_rate(_labelled(spark, sf_dir), "quality")


@query("SELECT count(*) AS n FROM labels WHERE toxic = 1")
def q_decision_count(spark, sf_dir):
    return A.filtered_count(table(spark, sf_dir, "labels"), {"toxic": 1})


@query("""
SELECT count(*) FILTER (WHERE toxic = 1) AS n_condition, 100.0::DOUBLE * count(*) FILTER (WHERE toxic = 1 AND quality = 1) / count(*) FILTER (WHERE toxic = 1) AS rate_pct FROM labels
""")
def q_oversight_rate(spark, sf_dir):
    return A.conditional_rate(table(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 1)


@query("""
SELECT count(*) AS n_groups, min(rate) / max(rate) AS disparate_impact
FROM (SELECT lang, sum(quality) / count(quality) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1)
""")
def q_disparate_impact(spark, sf_dir):
    return A.disparate_impact(_labelled(spark, sf_dir, "inner"), "lang", "quality")


@query("""
WITH s AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM s)
SELECT CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS n_pos, CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS n_neg,
  (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc
FROM r
""")
def q_roc_auc(spark, sf_dir):
    return A.roc_auc(_labelled(spark, sf_dir, "inner"), "quality", "n_chars")


@query("""
WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events)
SELECT count(*) AS n,
  round(0.5::DOUBLE * (sum(c) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'click'))
   + 0.3::DOUBLE * (sum(c) FILTER (WHERE event_type = 'view') / count(*) FILTER (WHERE event_type = 'view'))
   + 0.2::DOUBLE * (sum(c) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type = 'purchase'))
   + 0.000001::DOUBLE * sum(c) + 1.5::DOUBLE, 4) AS score
FROM e
""")
def q_sensor_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", cents(F.col("value")).alias("c"))
    sums = e.agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("all"), *[f(F.when(F.col("event_type") == k, F.col("c"))).alias(f"{k}_{n}") for k in ("click", "view", "purchase") for n, f in (("sum", F.sum), ("n", F.count))])
    mean = lambda k: F.col(f"{k}_sum") / F.col(f"{k}_n")
    score = 0.5 * mean("click") + 0.3 * mean("view") + 0.2 * mean("purchase") + 0.000001 * F.col("all") + 1.5
    return sums.select("n", F.round(score, 4).alias("score"))


@query("""
WITH s AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id),
t AS (SELECT user_id, v, v[CAST(floor(len(v) * 0.2::DOUBLE) AS BIGINT) + 1] AS low, v[CAST(floor(len(v) * 0.8::DOUBLE) AS BIGINT) + 1] AS high FROM s),
c AS (SELECT user_id, len(v) AS n, low, high, len(list_filter(v, lambda x: x <= low)) AS n_low, len(list_filter(v, lambda x: x >= high)) AS n_high FROM t)
SELECT user_id, n, low, high, CAST(n_low AS BIGINT) AS n_low, CAST(n_high AS BIGINT) AS n_high,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, (low - 10.0::DOUBLE) / 90.0::DOUBLE)) * 0.5 + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (high - 50.0::DOUBLE) / 350.0::DOUBLE)) * 0.5 AS score,
  n_low / n > 0.3 AS withheld
FROM c
""")
def q_energy_score(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    cuts = per.select("user_id", "v", A.at_index(F.col("v"), 0.2).alias("low"), A.at_index(F.col("v"), 0.8).alias("high"))
    counts = cuts.select("user_id", F.size("v").cast("long").alias("n"), "low", "high", F.size(F.filter("v", lambda x: x <= F.col("low"))).cast("long").alias("n_low"), F.size(F.filter("v", lambda x: x >= F.col("high"))).cast("long").alias("n_high"))
    score = clip((F.col("low") - 10.0) / 90.0, 0.0, 1.0) * 0.5 + clip((F.col("high") - 50.0) / 350.0, 0.0, 1.0) * 0.5
    return counts.select("*", score.alias("score"), (F.col("n_low") / F.col("n") > 0.3).alias("withheld"))
