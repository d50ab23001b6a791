"""Comparators, invariants and verdicts."""

from pyspark.sql import functions as F

from tallyspark.operators import compare as C
from tallyspark.operators import invariants as I
from tallyspark.operators.aggregates import weakest
from tallyspark.operators.rules import all_rooted
from tallyspark.plans import verdict as V
from tallyspark.queries import query
from tallyspark.sources.tables import table


def _nation(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), "n_name", F.col("n_regionkey").cast("double").alias("v"))


def _tampered(df):
    return df.where("ord <> 3").select("ord", F.when(F.col("ord") == 5, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"), F.when(F.col("ord") == 7, F.col("v") + 0.5).otherwise(F.col("v")).alias("v"))


@query("""
WITH a AS (SELECT n_nationkey AS ord, CASE WHEN n_nationkey = 5 THEN lower(n_name) ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 3)
SELECT e.n_nationkey AS ord, CASE WHEN a.ord IS NULL THEN '<row>' ELSE 'n_name' END AS "column", CASE WHEN a.ord IS NOT NULL THEN e.n_name END AS expected, a.n_name AS actual
FROM nation e LEFT JOIN a ON a.ord = e.n_nationkey WHERE e.n_name IS DISTINCT FROM a.n_name
""")
def q_cmp_exact(spark, sf_dir):
    e = _nation(spark, sf_dir).select("ord", "n_name")
    found = C.exact(e, _tampered(_nation(spark, sf_dir)).select("ord", "n_name"), "ord")
    return found.withColumn("expected", F.when(F.col("column") != "<row>", F.col("expected"))).select("ord", "column", "expected", "actual")


@query("""
SELECT n_nationkey AS ord, 'v' AS "column" FROM nation WHERE n_nationkey = 7 UNION ALL SELECT n_nationkey, '<row>' FROM nation WHERE n_nationkey = 3
""")
def q_cmp_epsilon(spark, sf_dir):
    e = _nation(spark, sf_dir)
    return C.scalar_epsilon(e, _tampered(e), "ord", ["v"], 0.1).select("ord", "column")


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber FROM lineitem), a AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 50 <> 0 UNION ALL SELECT 0, 1),
u AS (SELECT *, 1 AS s FROM e UNION ALL SELECT *, -1 FROM a)
SELECT l_orderkey, l_linenumber, CAST(sum(s) AS BIGINT) AS surplus FROM u GROUP BY 1, 2 HAVING sum(s) <> 0
""")
def q_cmp_multiset(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    a = e.where("l_orderkey % 50 <> 0").unionByName(spark.createDataFrame([(0, 1)], e.schema))
    return C.multiset(e, a)


@query("""SELECT n_nationkey AS ord, '<row>' AS "column" FROM nation WHERE n_nationkey = 3 UNION ALL SELECT n_nationkey, 'n_name' FROM nation WHERE n_nationkey = 5""")
def q_cmp_structured(spark, sf_dir):
    e = _nation(spark, sf_dir)
    return C.structured(e, _tampered(e), "ord", ["n_name"]).select("ord", "column")


@query("""SELECT n_nationkey AS ord, '<row>' AS "column" FROM nation WHERE n_nationkey = 3""")
def q_cmp_text(spark, sf_dir):
    """Case is no difference after normalisation."""
    e = _nation(spark, sf_dir)
    return C.text_normalized(e, _tampered(e), "ord", ["n_name"]).select("ord", "column")


_SETS = """
WITH s AS (SELECT c_custkey, list_sort(list(o_orderkey)) AS a, list_sort(list(o_orderkey) FILTER (WHERE o_orderstatus <> 'P')) AS b,
  list_sort(list(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 ELSE o_orderkey END) FILTER (WHERE o_orderstatus = 'F')) AS c FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
"""


@query(_SETS + """
SELECT c_custkey, CASE WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 THEN 'context not in retrieved' ELSE 'quoted not in context' END AS reason
FROM s WHERE len(list_filter(coalesce(c, []), lambda x: NOT list_contains(coalesce(b, []), x))) > 0
""")
def q_three_set(spark, sf_dir):
    """Customers whose quoted orders aren't all among those in context, or these among those retrieved."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    sets = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_sort(F.collect_list(k)).alias("retrieved"),
        F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") != "P", k))).alias("context"),
        F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.when(k % 11 == 0, k + 1).otherwise(k)))).alias("quoted"),
    )
    return I.subset_chain(sets, "retrieved", "context", "quoted").select("c_custkey", "reason")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_monotone_growth(spark, sf_dir):
    return I.monotone_growth(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


_OWNED = """
SELECT d.doc_id AS path, CASE WHEN max(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'LABELLED' WHEN max(CASE WHEN b.item_id IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'BENCHMARK' ELSE 'UNOWNED' END AS owner
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id GROUP BY d.doc_id
"""


def _owned(spark, sf_dir):
    owners = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.lit("LABELLED").alias("kind")).union(table(spark, sf_dir, "benchmark").select("item_id", F.lit("BENCHMARK")))
    return I.conservation(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path")), owners, ["LABELLED", "BENCHMARK"])


@query(_OWNED)
def q_conservation(spark, sf_dir):
    return _owned(spark, sf_dir)


@query(f"SELECT owner, count(*) AS n FROM ({_OWNED}) GROUP BY 1")
def q_kind_counts(spark, sf_dir):
    return I.kind_counts(_owned(spark, sf_dir))


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("SELECT o_custkey, max(o_orderpriority) AS weakest FROM orders GROUP BY 1")
def q_weakest_link(spark, sf_dir):
    return weakest(table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.trim("o_orderpriority")), ["o_custkey"], "o_orderpriority", PRIORITIES)


@query("""
SELECT path, declared, floor FROM (SELECT o_orderkey AS path, o_orderpriority AS declared, CASE WHEN o_orderstatus = 'F' THEN '3-MEDIUM' ELSE '5-LOW' END AS floor FROM orders)
WHERE declared > floor AND path <> 1
""")
def q_floor_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("declared"), F.when(F.col("o_orderstatus") == "F", "3-MEDIUM").otherwise("5-LOW").alias("floor"))
    return I.rank_floor(rows, "declared", "floor", PRIORITIES, allowed=[1])


@query("""
SELECT 'REJECT' AS verdict, 'REJECT' AS severity,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) + (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_findings
""")
def q_verdict_compose(spark, sf_dir):
    """Orders without lines are rejected, documents nobody labelled could not be concluded; an advisory crash doesn't count."""
    lone = table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left_anti")
    open_ = I.uncovered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    found = V.findings(lone, "lines", "REJECT", "no_lines", "o_orderkey").unionByName(V.findings(open_, "labels", "INCOMPLETE", "not_labelled", "doc_id"))
    found = found.unionByName(V.findings(spark.range(1), "advice", "CRASH", "crashed", "id"))
    return V.compose(found, gating=["lines", "labels"])


@query("""
SELECT 'price_is_positive' AS test, '1' AS version, bool_and(o_totalprice > 0) AND count(*) > 0 AS passed, count(*) AS n FROM orders
UNION ALL SELECT 'is_final', '1', bool_and(o_orderstatus = 'F') AND count(*) > 0, count(*) FROM orders
""")
def q_control_tests(spark, sf_dir):
    """Named, versioned tests over evidence rows; each passes if there are rows and all hold."""
    orders = table(spark, sf_dir, "orders")
    tests = {("price_is_positive", "1"): F.col("o_totalprice") > 0, ("is_final", "1"): F.col("o_orderstatus") == "F"}
    return I.union_all([all_rooted(orders, holds).select(F.lit(t).alias("test"), F.lit(v).alias("version"), F.col("admitted").alias("passed"), "n") for (t, v), holds in tests.items()])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def q_unique_lookup(spark, sf_dir):
    from tallyspark.sources.files import lookup_one

    return lookup_one(table(spark, sf_dir, "nation"), "n_nationkey", 7).select("n_nationkey", "n_name")


@query("SELECT doc_id, quality FROM labels WHERE quality NOT IN (1) OR quality IS NULL")
def q_enum_check(spark, sf_dir):
    return I.outside(table(spark, sf_dir, "labels").withColumn("q", F.col("quality").cast("string")), "q", ["1"]).select("doc_id", "quality")


@query("""
SELECT user_id FROM (SELECT user_id, list(event_type ORDER BY ts, event_id) AS l FROM events GROUP BY 1) WHERE l <> list_sort(l)
""")
def q_sorted_arrays(spark, sf_dir):
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("l"))
    return lists.where(I.not_sorted("l")).select("user_id")


@query("SELECT p_brand, count(DISTINCT p_type) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def q_binding_strictness(spark, sf_dir):
    return I.one_value_each(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("""
WITH t AS (SELECT user_id, count(*) AS eligible, count(*) FILTER (WHERE event_type = 'purchase') AS issued, count(*) FILTER (WHERE event_type <> 'purchase') AS withheld,
  count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1)
SELECT user_id, CASE WHEN issued + withheld <> eligible THEN 'issued + withheld <> eligible' ELSE 'reasons <> withheld' END AS reason FROM t WHERE issued + withheld <> eligible OR a + b <> withheld
""")
def q_coverage_sum(spark, sf_dir):
    kind = F.col("event_type")
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(kind == "purchase").alias("issued"), F.count_if(kind != "purchase").alias("withheld"), F.create_map(F.lit("click"), F.count_if(kind == "click"), F.lit("view"), F.count_if(kind == "view")).alias("reasons"))
    return I.coverage_sum(t, "eligible", "issued", "withheld", "reasons").select("user_id", "reason")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1
""")
def q_cross_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select("o_orderkey")
    return I.orphans(refs, "o_orderkey", table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")))


@query("""
WITH d AS (SELECT doc_id AS path, sha256(text) AS s FROM documents), f AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 100 = 0 THEN text || '!' ELSE text END) AS s FROM documents WHERE doc_id % 100 <> 1)
SELECT d.path, CASE WHEN f.s IS NULL THEN 'missing' ELSE 'digest differs' END AS reason FROM d LEFT JOIN f USING (path) WHERE f.s IS NULL OR f.s <> d.s
""")
def q_file_integrity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    declared = docs.select("path", F.upper(F.sha2("text", 256)).alias("sha256"))
    changed = F.when(F.col("path") % 100 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return I.integrity(declared, docs.where("path % 100 <> 1").select("path", F.sha2(changed, 256).alias("sha256")))


@query("""
WITH t AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS attributed, count(*) AS n, CASE WHEN user_id % 2 = 0 THEN 'first_match' ELSE 'all_attributed' END AS mode FROM events GROUP BY 1)
SELECT * FROM t WHERE CASE WHEN mode = 'first_match' THEN attributed = 0 ELSE attributed < n END
""")
def q_attribution_mode(spark, sf_dir):
    mode = F.when(F.col("user_id") % 2 == 0, "first_match").otherwise("all_attributed")
    return I.attribution(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase", mode)


@query("""
WITH r AS (SELECT o_orderkey, o_orderdate AS i, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 200 DAY END AS e, CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '1996-01-01' END AS n FROM orders)
SELECT o_orderkey, CASE WHEN i > TIMESTAMP '1996-06-01' THEN 'not_yet_valid' WHEN e < TIMESTAMP '1996-06-01' THEN 'expired' WHEN i + INTERVAL 900 DAY < TIMESTAMP '1996-06-01' THEN 'stale' WHEN n <= TIMESTAMP '1996-06-01' THEN 'revoked' ELSE 'fresh' END AS state FROM r
""")
def q_revocation(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    lists = table(spark, sf_dir, "orders").select("o_orderkey", at.alias("issued_at"), F.when(F.col("o_orderkey") % 3 == 0, at + F.expr("interval 200 days")).alias("expires_at"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("1996-01-01").cast("timestamp")).alias("not_after"))
    return I.revocation(lists, "1996-06-01 00:00:00", 900).select("o_orderkey", "state")


@query("""
SELECT doc_id, 'toxic needs quality' AS rule FROM labels WHERE toxic = 1 AND NOT quality = 1
UNION ALL SELECT doc_id, 'bad is not toxic' FROM labels WHERE quality = 0 AND NOT toxic = 0
""")
def q_source_rules(spark, sf_dir):
    rules = {"toxic needs quality": (F.col("toxic") == 1, F.col("quality") == 1), "bad is not toxic": (F.col("quality") == 0, F.col("toxic") == 0)}
    return I.implications(table(spark, sf_dir, "labels"), rules).select("doc_id", "rule")


@query("""
SELECT p_partkey FROM part WHERE p_size < 10 OR p_retailprice < 1000
""")
def q_profile_floor(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(10).alias("f1"), F.lit(1000.0).alias("f2"))
    return I.componentwise_below(rows, ["p_size", "p_retailprice"], ["f1", "f2"]).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE strlen(text) < 32")
def q_low_entropy(spark, sf_dir):
    return I.low_entropy(table(spark, sf_dir, "documents"), "text").select("doc_id")
