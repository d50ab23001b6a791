"""Deep checks of manifests: a bundle for each customer, whose orders are its snapshots; keys decide what is damaged."""

from pyspark.sql import functions as F

from tallyspark.operators.manifests import Manifests, first_faults, manifest_faults
from tallyspark.queries import query
from tallyspark.sources.lineage import cut
from tallyspark.sources.tables import table


def _manifests(spark, sf_dir) -> Manifests:
    e = F.expr
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    orders = orders.withColumns({"path": e("concat('o/', k)"), "cid": e("concat('sha256:', sha2(concat(k, '|', o_orderpriority), 256))")})
    final = orders.where("o_orderstatus = 'F'")
    sets = orders.groupBy("bundle").agg(e("array_sort(collect_list(case when o_orderstatus = 'F' then struct(cid, k) end))").alias("all"))
    sets = sets.selectExpr("bundle", "concat('t', bundle) as trace", "transform(all, x -> x.cid) as candidates", "transform(filter(all, x -> x.k % 2 = 0), x -> x.cid) as context", "transform(filter(all, x -> x.k % 4 = 0), x -> x.cid) as quoted")
    sets = cut(sets)
    bundles = table(spark, sf_dir, "customer").join(sets.select(F.col("bundle").alias("c_custkey")), "c_custkey").withColumnRenamed("c_custkey", "bundle")
    bundles = bundles.selectExpr(
        "bundle", "case when bundle % 40 <> 6 then sha2('policy', 256) end as policy_sha", "'decisions.jsonl' as decision_log", "concat('t', bundle) as trace", "case when bundle % 45 <> 13 then 'trace.jsonl' end as trace_log",
        "case when bundle % 67 = 17 then null when bundle % 71 = 18 then 'loud' when bundle % 2 = 0 then 'verified_extractive' else 'exploratory_synthesis' end as mode",
        "concat(bundle, '|', c_name) as header", "case when bundle % 3 > 0 then upper(sha2(case when bundle % 73 = 20 then 'x' else concat(bundle, '|', c_name) end, 256)) end as header_leaf",
    )
    bundles = cut(bundles)
    files = orders.where("k % 211 <> 7").selectExpr("bundle", "path", "case when k % 223 = 8 then 'sha256:0' else cid end as cid")
    files = files.unionByName(bundles.where("bundle % 41 <> 12").selectExpr("bundle", "'decisions.jsonl' as path", "'' as cid"))
    files = files.unionByName(bundles.where("bundle % 43 <> 14").selectExpr("bundle", "'trace.jsonl' as path", "'' as cid"))
    return Manifests(
        bundles=bundles,
        files=files,
        snapshots=orders.select("bundle", "cid", "path"),
        ingests=orders.selectExpr("bundle", "path", "case when k % 5 = 0 then null when k % 307 = 8 then 'old' else sha2('policy', 256) end as policy_sha"),
        anchors=orders.selectExpr("bundle", "concat('a', k) as name", """concat('{"kind":"byte_offset","source_cid":"', cid, '","start":0,"end":', k % 397, '}') as fragment"""),
        attributes=final.selectExpr("bundle", "case when k % 409 = 11 then concat(cid, 'x') else cid end as cid", "case when k % 401 = 11 then 'tabloid' else 'press' end as publication_class", "k % 3 = 0 as signed", "case when k % 411 > 0 then 'key' end as signing_key", "k % 2 = 0 as issuer_verified", "case when k % 414 > 0 then 'issuer' end as issuer"),
        decisions=final.where("k % 419 <> 12").selectExpr("bundle", "'decisions.jsonl' as path", "case when k % 409 = 11 then concat(cid, 'x') else cid end as cid"),
        traces=sets.where("bundle % 47 <> 14").selectExpr("bundle", "'trace.jsonl' as path", "trace", "candidates", "context", "explode(sequence(1, case when bundle % 53 = 14 then 2 else 1 end)) as n").drop("n"),
        outputs=sets.selectExpr("bundle", "concat('out', bundle) as output", "trace", "case when bundle % 59 <> 16 then '2024-01-01' end as emitted_at", "candidates as retrieved", "case when bundle % 61 = 16 then candidates else context end as injected", "quoted"),
    )


@query("""
WITH o AS (SELECT o_custkey AS b, o_orderkey AS k, o_orderstatus AS s, 'o/' || o_orderkey AS path, 'sha256:' || sha256(o_orderkey || '|' || o_orderpriority) AS cid FROM orders),
t AS (SELECT b, coalesce(list(cid ORDER BY cid) FILTER (WHERE s = 'F'), []) AS candidates, coalesce(list(cid ORDER BY cid) FILTER (WHERE s = 'F' AND k % 2 = 0), []) AS context,
  coalesce(list(cid ORDER BY cid) FILTER (WHERE s = 'F' AND k % 4 = 0), []) AS quoted FROM o GROUP BY 1),
m AS (SELECT t.*, c_name, CASE WHEN b % 67 = 17 THEN NULL WHEN b % 71 = 18 THEN 'loud' WHEN b % 2 = 0 THEN 'verified_extractive' ELSE 'exploratory_synthesis' END AS mode,
  b % 45 <> 13 AND b % 43 <> 14 AS logged, CASE WHEN b % 47 = 14 THEN 0 WHEN b % 53 = 14 THEN 2 ELSE 1 END AS times FROM t JOIN customer ON c_custkey = b),
a AS (SELECT *, CASE WHEN k % 409 = 11 THEN cid || 'x' ELSE cid END AS acid FROM o WHERE s = 'F'),
f(b, number, subject, reason) AS (
SELECT b, 6, '', 'no policy' FROM m WHERE b % 40 = 6
UNION ALL SELECT b, 7, cid, CASE WHEN k % 211 = 7 THEN 'missing' ELSE 'address differs' END FROM o WHERE k % 211 = 7 OR k % 223 = 8
UNION ALL SELECT b, 8, path, 'another policy' FROM o WHERE k % 307 = 8 AND k % 5 <> 0 AND b % 40 <> 6
UNION ALL SELECT b, 9, 'a' || k, 'out of bounds' FROM o WHERE k % 397 = 0
UNION ALL SELECT b, 10, 'a' || k, 'source is missing' FROM o WHERE k % 397 <> 0 AND k % 211 = 7
UNION ALL SELECT * FROM (SELECT b, 11, acid, CASE WHEN k % 409 = 11 THEN 'no snapshot' WHEN k % 401 = 11 THEN 'unknown class' WHEN k % 411 = 0 THEN 'signed without a key' WHEN k % 414 = 0 THEN 'verified without an issuer' END AS r FROM a) WHERE r IS NOT NULL
UNION ALL SELECT b, 12, 'decisions.jsonl', 'no log' FROM m WHERE b % 41 = 12
UNION ALL SELECT b, 12, acid, 'no decision' FROM a WHERE b % 41 <> 12 AND k % 419 = 12
UNION ALL SELECT b, 13, 't' || b, 'no log named' FROM m WHERE b % 45 = 13
UNION ALL SELECT b, 14, 't' || b, CASE WHEN b % 43 = 14 THEN 'no log' WHEN times = 0 THEN 'no trace' ELSE 'ambiguous trace' END FROM m WHERE b % 45 <> 13 AND (b % 43 = 14 OR times <> 1)
UNION ALL SELECT * FROM (SELECT b, 16, 'out' || b, CASE WHEN b % 59 = 16 THEN 'missing field' WHEN NOT logged OR times = 0 THEN 'no trace' WHEN times = 2 THEN 'ambiguous trace' WHEN b % 61 = 16 AND candidates <> context THEN 'stored differs' END AS r FROM m) WHERE r IS NOT NULL
UNION ALL SELECT b, 17, '', 'no mode' FROM m WHERE mode IS NULL
UNION ALL SELECT b, 18, mode, 'unknown mode' FROM m WHERE mode = 'loud'
UNION ALL SELECT b, 19, 'out' || b, 'nothing quoted' FROM m WHERE mode = 'verified_extractive' AND len(quoted) = 0
UNION ALL SELECT b, 20, '', 'header differs' FROM m WHERE b % 3 > 0 AND b % 73 = 20),
n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY number, subject, reason) AS r, count(*) OVER (PARTITION BY b) AS n FROM f)
SELECT m.b AS bundle, number, subject, reason, coalesce(n, 0) AS n_faults FROM m LEFT JOIN n ON n.b = m.b AND r = 1
""")
def q_manifest_deep(spark, sf_dir):
    """Each customer's bundle with the first of checks 6 to 20 that it fails."""
    m = _manifests(spark, sf_dir)
    return first_faults(m.bundles, manifest_faults(m))
