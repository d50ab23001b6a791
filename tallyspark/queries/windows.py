"""Windows, chains and replay."""

from pyspark.sql import functions as F

from tallyspark.functions.numbers import cents
from tallyspark.functions.times import micros, millis
from tallyspark.operators import windows as X
from tallyspark.queries import query
from tallyspark.sources.tables import table


def _cents(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("c", cents(F.col("value")))


@query("""
SELECT date_trunc('hour', ts) AS window_start, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_sum, count(*) AS event_count,
  max(CAST(round(value * 100) AS BIGINT)) AS value_max FROM events GROUP BY 1
""")
def q_tumbling(spark, sf_dir):
    return X.tumbling(_cents(spark, sf_dir), "ts", "1 hour", "c")


@query("""
SELECT epoch_us(ts) // 60000000 AS window_index, max(CAST(round(value * 100) AS BIGINT)) AS value_max FROM events GROUP BY 1
""")
def q_tumbling_max(spark, sf_dir):
    ms = _cents(spark, sf_dir).withColumn("w", X.window_index(millis(F.col("ts")), 60_000))
    return ms.groupBy(F.col("w").alias("window_index")).agg(F.max("c").alias("value_max"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, value, event_type = 'purchase' AND value > 150 AS big, event_type = 'purchase' AND value >= 90 AND value < 100 AS near FROM events),
v AS (SELECT *, CASE WHEN big THEN count(*) FILTER (WHERE big) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 86399999999 FOLLOWING) ELSE 0 END AS a,
  CASE WHEN near THEN count(*) FILTER (WHERE near) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 604799999999 FOLLOWING) ELSE 0 END AS b FROM e),
u AS (SELECT user_id, max(a) AS velocity, max(b) AS structuring, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM v GROUP BY 1)
SELECT user_id, velocity, structuring, (s / n - 5000.0::DOUBLE) / 2500.0::DOUBLE AS z_score,
  velocity >= 3 OR structuring >= 2 OR (s / n - 5000.0::DOUBLE) / 2500.0::DOUBLE > 3 AS flagged
FROM u
""")
def q_aml(spark, sf_dir):
    e = _cents(spark, sf_dir)
    buys = F.col("event_type") == "purchase"
    fast = X.forward_velocity(e, "user_id", "ts", buys & (F.col("value") > 150), 86_400, "velocity")
    near = X.forward_velocity(e, "user_id", "ts", buys & (F.col("value") >= 90) & (F.col("value") < 100), 7 * 86_400, "structuring")
    means = e.groupBy("user_id").agg(((F.sum("c") / F.count(F.lit(1)) - 5000.0) / 2500.0).alias("z_score"))
    joined = fast.join(near, "user_id").join(means, "user_id")
    return joined.withColumn("flagged", (F.col("velocity") >= 3) | (F.col("structuring") >= 2) | (F.col("z_score") > 3))


@query("""
WITH d AS (SELECT user_id, lead(60000.0::DOUBLE / (40 + value)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 60000.0::DOUBLE / (40 + value) AS d FROM events)
SELECT user_id, round(coalesce(sqrt(avg(d * d)), 0), 6) AS rmssd_ms FROM d GROUP BY 1
""")
def q_rmssd(spark, sf_dir):
    rates = table(spark, sf_dir, "events").withColumn("rate", F.col("value") + 40)
    return X.rmssd(rates, "user_id", ["ts", "event_id"], "rate").select("user_id", F.round("rmssd_ms", 6).alias("rmssd_ms"))


@query("""
WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT event_type, h, h - row_number() OVER (PARTITION BY event_type ORDER BY h) AS g FROM h WHERE n >= 2)
SELECT event_type, min(h) AS first, max(h) + 1 AS last FROM g GROUP BY event_type, g HAVING count(*) >= 2
""")
def q_islands(spark, sf_dir):
    hours = table(spark, sf_dir, "events").groupBy("event_type", X.window_index(millis(F.col("ts")), 3_600_000).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return X.islands(hours, "event_type", "h", F.col("n") >= 2, least=2)


@query("""
WITH c AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS counter FROM lineitem GROUP BY 1, 2),
g AS (SELECT *, coalesce(lag(counter) OVER (PARTITION BY l_orderkey ORDER BY counter), 0) + 1 AS expected FROM c)
SELECT * FROM g WHERE counter <> expected
""")
def q_counter_gaps(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("counter")).distinct()
    return X.counter_gaps(lines, ["l_orderkey"], "counter")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS counter, ts,
  max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM events)
SELECT event_id, user_id, event_type, counter, highest_before FROM e WHERE counter <= highest_before
""")
def q_channel_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.floor("value").cast("long").alias("counter"))
    return X.not_increasing(e, ["user_id", "event_type"], ["ts", "event_id"], "counter").drop("ts")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS occurrence FROM lineitem)
SELECT * FROM r WHERE occurrence > 1
""")
def q_replay(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return X.replays(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_suppkey", "l_extendedprice")


@query("""
WITH c AS (SELECT conv_id, turn, sha256(role || text) AS own FROM conversations),
p AS (SELECT *, CASE WHEN turn % 3 = 2 THEN sha256('tampered') ELSE lag(own) OVER (PARTITION BY conv_id ORDER BY turn) END AS previous, lag(own) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM c)
SELECT conv_id, turn, expected, previous FROM p WHERE expected IS NOT NULL AND expected IS DISTINCT FROM previous
""")
def q_hash_link(spark, sf_dir):
    from pyspark.sql import Window as W

    own = F.sha2(F.concat("role", "text"), 256)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("own"))
    claimed = F.when(F.col("turn") % 3 == 2, F.sha2(F.lit("tampered"), 256)).otherwise(F.lag("own").over(W.partitionBy("conv_id").orderBy("turn")))
    return X.broken_links(turns.withColumn("previous", claimed), ["conv_id"], ["turn"], "own", "previous").select("conv_id", "turn", "expected", "previous")


@query("""
SELECT conv_id, list_reduce(list(leaf ORDER BY turn), lambda h, x: sha256(h || x), sha256('genesis')) AS head
FROM (SELECT conv_id, turn, sha256(role || text) AS leaf FROM conversations) GROUP BY conv_id
""")
def q_chain_head(spark, sf_dir):
    import hashlib

    turns = table(spark, sf_dir, "conversations")
    return X.chain_head(turns, ["conv_id"], F.col("turn"), F.sha2(F.concat("role", "text"), 256), hashlib.sha256(b"genesis").hexdigest())


@query("""
WITH RECURSIVE l AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, sha256(unhex('01' || sha256(role || text))) AS h FROM conversations),
t AS (
  SELECT conv_id, 0 AS level, list(h ORDER BY i) AS hs FROM l GROUP BY conv_id
  UNION ALL
  SELECT conv_id, level + 1, list_transform(range(1, len(hs) + 1, 2), lambda i: sha256(unhex('00' || hs[i] || coalesce(hs[i + 1], hs[i])))) FROM t WHERE len(hs) > 1)
SELECT conv_id, hs[1] AS root FROM t WHERE len(hs) = 1
""")
def q_merkle_root(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.sha2(F.concat("role", "text"), 256).alias("leaf")).alias("it"))
    gathered = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("it")), lambda x: x["leaf"]).alias("leaves"))
    return gathered.select("conv_id", X.merkle_root(F.col("leaves"), levels=12).alias("root"))


@query("""
SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id
""")
def q_concat_digest(spark, sf_dir):
    gathered = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    return gathered.select("conv_id", F.sha2(F.array_join(F.transform("ts", lambda t: t["text"]), ""), 256).alias("digest"))


@query("""
SELECT user_id, event_type AS field, arg_max(CAST(round(value * 100) AS BIGINT), struct_pack(t := ts, e := event_id)) AS last_value FROM events GROUP BY 1, 2
""")
def q_event_replay(spark, sf_dir):
    e = _cents(spark, sf_dir)
    return e.groupBy("user_id", F.col("event_type").alias("field")).agg(F.max_by("c", F.struct("ts", "event_id")).alias("last_value"))


@query("""
SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS status, max(ts) AS since FROM events GROUP BY 1
""")
def q_latest_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("since"))


@query("""
SELECT o_custkey, max(epoch_us(o_orderdate)) AS max_low, min(epoch_us(o_orderdate) + 86400000000 * 400) AS min_high FROM orders GROUP BY 1
HAVING max(epoch_us(o_orderdate)) > min(epoch_us(o_orderdate) + 86400000000 * 400)
""")
def q_interval_convergence(spark, sf_dir):
    from tallyspark.operators.invariants import interval_conflicts

    spans = table(spark, sf_dir, "orders").select("o_custkey", micros(F.col("o_orderdate")).alias("low"))
    return interval_conflicts(spans.withColumn("high", F.col("low") + 86_400_000_000 * 400), "o_custkey", "low", "high")


@query("""
WITH r AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rank FROM part)
SELECT p_partkey, rank, rank <= 10 AS advanced FROM r
""")
def q_rank_topn(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return X.ranked(parts, [F.col("p_retailprice"), F.col("p_partkey")], 10).select("p_partkey", "rank", "advanced")
