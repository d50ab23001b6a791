"""Bounded closures over the key relations of the tables."""

from pyspark.sql import functions as F

from tallyspark.operators.graph import dependency_closure, reachable
from tallyspark.queries import query
from tallyspark.sources.tables import table


@query("""
WITH RECURSIVE e AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'r' || s_suppkey % 5 FROM supplier WHERE s_suppkey % 9 = 0),
t AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM t JOIN e ON src = node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM t WHERE node <> 'r0' GROUP BY 1
""")
def q_reachability(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    tag = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    edges = (
        nation.select(tag("r", F.col("n_regionkey")).alias("src"), tag("n", F.col("n_nationkey")).alias("dst"))
        .union(supplier.select(tag("n", F.col("s_nationkey")), tag("s", F.col("s_suppkey"))))
        .union(supplier.where("s_suppkey % 9 = 0").select(tag("s", F.col("s_suppkey")), tag("r", F.col("s_suppkey") % 5)))
    )
    found = reachable(edges, spark.createDataFrame([("r0",)], "start string"), 4)
    return found.select("node", "depth")


@query("""
WITH RECURSIVE p AS (SELECT 'p' || p_partkey AS id, sha256(p_name) AS hash, CASE WHEN p_partkey * 2 <= 600 THEN ['p' || p_partkey * 2, 'p' || p_partkey * 2 + 1] ELSE [] END AS deps FROM part),
t AS (SELECT 'p1' AS id, 0 AS depth UNION SELECT unnest(deps), depth + 1 FROM t JOIN p USING (id) WHERE depth < 100),
m AS (SELECT id, min(depth) AS depth FROM t GROUP BY 1)
SELECT id, depth, coalesce(hash, '') AS hash, CAST(coalesce(len(deps), 0) AS INTEGER) AS n_deps FROM m LEFT JOIN p USING (id)
""")
def q_dependency_closure(spark, sf_dir):
    key = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("p"), n.cast("string"))
    deps = F.when(key * 2 <= 600, F.array(name(key * 2), name(key * 2 + 1))).otherwise(F.array().cast("array<string>"))
    packages = table(spark, sf_dir, "part").select(name(key).alias("id"), F.sha2("p_name", 256).alias("hash"), deps.alias("deps"))
    return dependency_closure(packages, "p1")


@query("""
WITH RECURSIVE e AS (SELECT 'p' || p_partkey // 2 AS src, 'p' || p_partkey AS dst FROM part WHERE p_partkey > 1),
t AS (SELECT 'p1' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM t JOIN e ON src = id),
n AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), p AS (SELECT 'p' || p_partkey AS id, sha256(p_name) AS hash FROM part)
SELECT t.id, t.depth, coalesce(hash, '') AS hash, CAST(coalesce(n, 0) AS INTEGER) AS n_deps FROM t LEFT JOIN p USING (id) LEFT JOIN n USING (id)
""")
def q_dependency_closure_all(spark, sf_dir):
    """The closure over the whole part table: a part depends on those of twice its key and one more, where they exist."""
    name = lambda n: F.concat(F.lit("p"), n.cast("string"))
    parts = table(spark, sf_dir, "part")
    parent = F.floor(F.col("p_partkey") / 2).cast("long")
    deps = parts.where("p_partkey > 1").groupBy(name(parent).alias("id")).agg(F.collect_list(name(F.col("p_partkey"))).alias("deps"))
    packages = parts.select(name(F.col("p_partkey")).alias("id"), F.sha2("p_name", 256).alias("hash")).join(deps.hint("merge"), "id", "left")
    packages = packages.withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    return dependency_closure(packages, "p1")
