"""Row-wise decisions, pay arithmetic, classifiers."""

from pyspark.sql import functions as F

from tallyspark.functions import numbers as N
from tallyspark.queries import query
from tallyspark.sources.tables import table


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS prior, o_orderkey * 37 % 400000 AS period, o_orderkey % 30 AS week FROM orders),
w AS (SELECT *, (prior + 26) // 52 AS weekly FROM c)
SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'DENIED' WHEN prior < 500000 THEN 'DENIED' WHEN period > (weekly * 6000 + 5000) // 10000 THEN 'DENIED' WHEN week < 4 OR week > 25 THEN 'DENIED' ELSE 'APPROVED' END AS verdict,
  CAST(CASE WHEN o_orderstatus NOT IN ('F', 'O') OR prior < 500000 OR period > (weekly * 6000 + 5000) // 10000 OR week < 4 OR week > 25 THEN 0 ELSE least((weekly * 5500 + 5000) // 10000, 150000) END AS BIGINT) AS weekly_cents
FROM w
""")
def q_eligibility(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", N.cents(F.col("o_totalprice")).alias("prior"), (F.col("o_orderkey") * 37 % 400_000).alias("period"), (F.col("o_orderkey") % 30).alias("week"))
    w = c.withColumn("weekly", N.half_up(F.col("prior"), 52))
    denied = (~F.col("o_orderstatus").isin("F", "O"), F.col("prior") < 500_000, F.col("period") > N.half_up(F.col("weekly") * 6000, 10_000), ~F.col("week").between(4, 25))
    verdict = N.cascade(*[(d, "DENIED") for d in denied], otherwise="APPROVED")
    benefit = F.least(N.half_up(F.col("weekly") * 5500, 10_000), F.lit(150_000).cast("long"))
    return w.select("o_orderkey", verdict.alias("verdict"), F.when(verdict == "APPROVED", benefit).otherwise(0).cast("long").alias("weekly_cents"))


@query("""
WITH s AS (SELECT c_custkey, (greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0) * 12 + 13) // 26 AS gross FROM customer),
t AS (SELECT *, (gross * 2050 + 5000) // 10000 AS tax, (gross * 950 + 5000) // 10000 AS pension FROM s)
SELECT c_custkey, gross AS gross_cents, tax AS tax_cents, pension AS pension_cents, gross - tax - pension AS net_cents FROM t
""")
def q_half_up(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select("c_custkey", N.half_up(F.greatest(N.cents(F.col("c_acctbal")), F.lit(0).cast("long")) * 12, 26).alias("gross_cents"))
    t = s.select("*", N.half_up(F.col("gross_cents") * 2050, 10_000).alias("tax_cents"), N.half_up(F.col("gross_cents") * 950, 10_000).alias("pension_cents"))
    return t.withColumn("net_cents", F.col("gross_cents") - F.col("tax_cents") - F.col("pension_cents"))


@query("""
WITH s AS (SELECT p_partkey, (p_retailprice * 2) * (p_size / 100.0::DOUBLE / 2) / ((0.05::DOUBLE * (p_size / 100.0::DOUBLE) * (p_size / 100.0::DOUBLE) * (p_size / 100.0::DOUBLE)) / 12) AS stress FROM part)
SELECT p_partkey, CASE WHEN 25000000.0 / stress >= 1.5 THEN 'pass' ELSE 'fail' END AS verdict FROM s
""")
def q_strength_verdict(spark, sf_dir):
    height = F.col("p_size") / 100.0
    stress = (F.col("p_retailprice") * 2) * (height / 2) / ((0.05 * height * height * height) / 12)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(25_000_000.0 / stress >= 1.5, "pass").otherwise("fail").alias("verdict"))


#: Fixed integer weights, made by a rule.
CLASS_WEIGHTS = [[(7 * c + 3 * i + c * i) % 11 - 5 for i in range(64)] for c in range(4)]
_SUMS = ", ".join(f"list_sum(list_transform(range(1, 65), lambda i: q[i] * ((7 * {c} + 3 * (i - 1) + {c} * (i - 1)) % 11 - 5)))" for c in range(4))


@query(f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS q FROM embeddings),
s AS (SELECT vec_id, [{_SUMS}] AS l FROM e)
SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS class, CAST(list_max(l) AS BIGINT) AS logit FROM s
""")
def q_linear_classifier(spark, sf_dir):
    quantised = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long"))
    logits = F.array(*[N.dot(w, F.col("q")) for w in CLASS_WEIGHTS])
    scored = table(spark, sf_dir, "embeddings").select("vec_id", quantised.alias("q")).select("vec_id", logits.alias("l"))
    return scored.select("vec_id", N.first_argmax(F.col("l")).alias("class"), F.array_max("l").alias("logit"))


@query("""
SELECT vec_id, CAST(CAST(list_reduce(list_transform(range(1, 65), lambda i: CAST((i - 1) % 5 AS DOUBLE) * 0.25::DOUBLE * CAST(embedding[i] AS DOUBLE)), lambda a, b: a + b, 0.5::DOUBLE) AS FLOAT) AS DOUBLE) AS logit FROM embeddings
""")
def q_float32_logit(spark, sf_dir):
    weights = [i % 5 * 0.25 for i in range(64)]
    return table(spark, sf_dir, "embeddings").select("vec_id", N.float32_dot(weights, F.col("embedding"), 0.5).alias("logit"))


@query()
def q_char_hash(spark, sf_dir):
    """No statement: DuckDB has no CRC-32 here; a test holds it against zlib."""
    parts = table(spark, sf_dir, "part").select("p_partkey", N.character_buckets(F.col("p_name"), 32).alias("b"))
    return parts.select("p_partkey", N.dot(list(range(-16, 16)), F.transform("b", lambda x: x.cast("long"))).alias("affinity"))


@query("""
WITH v AS (SELECT a.x, b.y FROM (SELECT unnest(range(-2, 3)) AS x) a, (SELECT unnest(range(-2, 3)) AS y) b),
p AS (SELECT p_partkey, p_size % 7 - 3 AS low, p_partkey % 9 - 4 AS high FROM part)
SELECT p_partkey, low, high, bool_or(x > low AND NOT (y <= high OR x = y)) AS both, bool_or(low < x AND x < high) AS between, bool_or(x <> 0 AND high = 4 OR y < low) AS either
FROM p, v GROUP BY 1, 2, 3
""")
def q_falsifiable(spark, sf_dir):
    """Three rules with each part's own bounds: whether they can fire at all."""
    from tallyspark.plans.falsify import can_fire

    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 7 - 3).cast("long").alias("low"), (F.col("p_partkey") % 9 - 4).alias("high"))
    return parts.select("*", can_fire("x > low and not (y <= high or x == y)", ["x", "y"]).alias("both"), can_fire("low < x < high", ["x"]).alias("between"), can_fire("x != 0 and high == 4 or y < low", ["x", "y"]).alias("either"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, 2 * (o_custkey % 64) + 1 AS x, 2 * (o_orderkey % 61) + 1 AS y FROM orders),
e(x0, y0, x1, y1) AS (VALUES (20, 10, 100, 30), (100, 30, 90, 110), (50, 60, 90, 110), (50, 60, 20, 100), (20, 10, 20, 100)),
n AS (SELECT o_orderkey, o_orderstatus, count(*) AS right_of FROM o JOIN e ON y >= y0 AND y < y1 AND x0 + (x1 - x0) * (y - y0) / CAST(y1 - y0 AS DOUBLE) > x GROUP BY 1, 2)
SELECT o_orderstatus, count(*) AS n_inside, CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM n WHERE right_of % 2 = 1 GROUP BY 1
""")
def q_point_in_polygon(spark, sf_dir):
    """Orders as cells of a grid: how many of each status lie in a polygon."""
    from tallyspark.operators.shapes import cells_inside

    cells = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 61).alias("row"), (F.col("o_custkey") % 64).alias("col"))
    held = cells_inside(cells, [(10, 5), (50, 15), (45, 55), (25, 30), (10, 50)])
    return held.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_inside"), F.sum("o_orderkey").alias("checksum"))
