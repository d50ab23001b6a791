"""Combinations of suppliers, part names and nations; owners of a tree of paths."""

from pyspark.sql import functions as F

from tallyspark.operators import ownership as O
from tallyspark.operators.combine import best_combinations, status_counts
from tallyspark.operators.invariants import kind_counts
from tallyspark.queries import query
from tallyspark.sources.tables import table

MEASURES = ["mw", "logp", "hbd"]
_COMBINED = """
WITH s AS (SELECT s_suppkey::VARCHAR AS k, CAST(floor(s_acctbal / 50) AS BIGINT) AS mw, s_suppkey % 30 AS logp, s_nationkey % 4 AS hbd FROM supplier),
p AS (SELECT p_name AS k, sum(p_size) % 150 AS mw, count(*) % 20 AS logp, min(p_size) % 3 AS hbd FROM part GROUP BY 1),
n AS (SELECT n_nationkey::VARCHAR AS k, n_nationkey * 11 AS mw, n_nationkey % 9 AS logp, n_regionkey % 2 AS hbd FROM nation),
c AS (SELECT s.k || '__' || p.k || '__' || n.k AS id, CAST(s.mw + p.mw + n.mw AS BIGINT) AS mw, CAST(s.logp + p.logp + n.logp AS BIGINT) AS logp, s.hbd + p.hbd + n.hbd AS hbd FROM s CROSS JOIN p CROSS JOIN n),
r AS (SELECT *, CASE WHEN mw > 350 THEN 'rejected:mw' WHEN logp > 40 THEN 'rejected:logp' WHEN hbd > 5 THEN 'rejected:hbd' ELSE 'passed' END AS status FROM c)
"""


def _sides(spark, sf_dir):
    e = F.expr
    s = table(spark, sf_dir, "supplier").select("s_suppkey", e("floor(s_acctbal / 50)").alias("mw"), e("s_suppkey % 30").alias("logp"), e("s_nationkey % 4").alias("hbd"))
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(e("sum(p_size) % 150").alias("mw"), e("count(*) % 20").alias("logp"), e("min(p_size) % 3").alias("hbd"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", e("n_nationkey * 11").alias("mw"), e("n_nationkey % 9").alias("logp"), e("n_regionkey % 2").alias("hbd"))
    sides = [df.withColumns({m: F.col(m).cast("long") for m in MEASURES}) for df in (s, p, n)]
    return sides, ["s_suppkey", "p_name", "n_nationkey"]


def _status(sums):
    return F.when(sums["mw"] > 350, "rejected:mw").when(sums["logp"] > 40, "rejected:logp").when(sums["hbd"] > 5, "rejected:hbd").otherwise("passed")


@query(_COMBINED + "SELECT status, count(*)::DECIMAL(38, 0) AS n FROM r GROUP BY 1")
def q_combi_status(spark, sf_dir):
    """How many of all suppliers with all part names in all nations have each status."""
    return status_counts(_sides(spark, sf_dir)[0], MEASURES, _status)


@query(_COMBINED + """
SELECT id, -12000000 + CAST('0x' || substr(sha256(id || '|7'), 1, 8) AS BIGINT) * 8 // 4096 + 8000 * (500 - mw) + 40000 * (60 - logp) AS score FROM r WHERE status = 'passed' ORDER BY score, id LIMIT 25
""")
def q_combi_best(spark, sf_dir):
    """The 25 best of those that pass, by whole-number scores in which a hash of the id adds up to 8388607."""
    sides, keys = _sides(spark, sf_dir)
    least = lambda s: -12000000 + 8000 * (500 - s["mw"]) + 40000 * (60 - s["logp"])
    drawn = lambda ids: F.floor(F.conv(F.substring(F.sha2(F.concat(F.concat_ws("__", *ids), F.lit("|7")), 256), 1, 8), 16, 10).cast("long") * 8 / 4096)
    return best_combinations(sides, keys, MEASURES, lambda s: _status(s) == "passed", least, lambda ids, s: least(s) + drawn(ids), 25)


PATTERNS = ["cache/*/*7.tmp", "logs/run[0-4]/*", "data/en/?.bin", "data/[!e]*1?.bin", "lo*/run5/*2?3.log"]
_PATHS = """
WITH q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'snapshots/' || doc_id WHEN 1 THEN 'spec/' || lang || '/' || doc_id || '.txt' WHEN 2 THEN 'cache/' || lang || '/' || doc_id || '.tmp'
  WHEN 3 THEN 'logs/run' || doc_id % 10 || '/' || doc_id || '.log' ELSE 'data/' || lang || '/' || CASE WHEN doc_id % 20 = 4 THEN '.keep' ELSE doc_id || '.bin' END END AS path FROM documents),
w AS (SELECT path, max(CASE WHEN doc_id % 7 = 0 AND doc_id % 20 <> 4 THEN 1 ELSE 0 END) AS appended, max(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id % 20 <> 4 THEN 1 ELSE 0 END) AS filed, max(CASE WHEN doc_id % 101 = 0 THEN 1 ELSE 0 END) AS odd FROM q GROUP BY 1),
o AS (SELECT *, CASE WHEN path LIKE 'cache/%/%7.tmp' THEN 'cache/*/*7.tmp' WHEN regexp_matches(path, '^logs/run[0-4]/') THEN 'logs/run[0-4]/*' WHEN path LIKE 'data/en/_.bin' THEN 'data/en/?.bin'
  WHEN regexp_matches(path, '^data/[^e].*1.[.]bin$') THEN 'data/[!e]*1?.bin' WHEN regexp_matches(path, '^lo.*/run5/.*2.3[.]log$') THEN 'lo*/run5/*2?3.log' END AS matched FROM w),
z AS (SELECT path, matched, CASE WHEN odd = 1 THEN 'IRREGULAR' WHEN appended = 1 THEN 'APPEND_ONLY' WHEN filed = 1 THEN 'FILE' WHEN path LIKE 'snapshots/%' THEN 'SNAPSHOTS' WHEN path LIKE 'spec/en/%' THEN 'SPEC'
  WHEN path LIKE '%/.keep' THEN 'SCAFFOLD' END AS named FROM o)
"""


def _tree(spark, sf_dir):
    path = F.expr("""case doc_id % 5 when 0 then concat('snapshots/', doc_id) when 1 then concat('spec/', lang, '/', doc_id, '.txt') when 2 then concat('cache/', lang, '/', doc_id, '.tmp')
        when 3 then concat('logs/run', doc_id % 10, '/', doc_id, '.log') else concat('data/', lang, '/', if(doc_id % 20 = 4, '.keep', concat(doc_id, '.bin'))) end""")
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.when(F.col("doc_id") % 101 == 0, "fifo").otherwise("file").alias("entry"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    own = docs.where("doc_id % 20 <> 4")
    owners = own.where("doc_id % 7 = 0").select("path", F.lit("APPEND_ONLY").alias("kind")).union(own.join(good, "doc_id", "left_semi").select("path", F.lit("FILE")))
    return docs, owners


def _conserved(spark, sf_dir, sealed):
    docs, owners = _tree(spark, sf_dir)
    return O.conserve(docs, owners, ["APPEND_ONLY", "FILE", "SNAPSHOTS", "SPEC", "SCAFFOLD"], trees={"snapshots": "SNAPSHOTS", "spec/en/": "SPEC"}, names={".keep": "SCAFFOLD"}, ignore=PATTERNS, sealed=sealed)


@query(_PATHS + """
SELECT path, coalesce(named, CASE WHEN matched IS NULL THEN 'UNOWNED' ELSE 'IGNORED' END) AS owner, CASE WHEN named IS NULL THEN matched END AS pattern FROM z
""")
def q_owned_tree(spark, sf_dir):
    """The one owner of every path, with what patterns let pass."""
    return _conserved(spark, sf_dir, False)


@query(_PATHS + "SELECT coalesce(named, 'UNOWNED') AS owner, count(*) AS n FROM z GROUP BY 1")
def q_owned_sealed(spark, sf_dir):
    """How many paths each kind owns in a sealed tree, where nothing is ignored."""
    return kind_counts(_conserved(spark, sf_dir, True))


@query(_PATHS + """
SELECT path, pattern FROM (SELECT path, unnest([CASE WHEN path LIKE 'cache/%/%7.tmp' THEN 'cache/*/*7.tmp' END, CASE WHEN regexp_matches(path, '^logs/run[0-4]/') THEN 'logs/run[0-4]/*' END, CASE WHEN path LIKE 'data/en/_.bin' THEN 'data/en/?.bin' END,
  CASE WHEN regexp_matches(path, '^data/[^e].*1.[.]bin$') THEN 'data/[!e]*1?.bin' END, CASE WHEN regexp_matches(path, '^lo.*/run5/.*2.3[.]log$') THEN 'lo*/run5/*2?3.log' END]) AS pattern FROM w WHERE appended = 1 OR filed = 1) WHERE pattern IS NOT NULL
""")
def q_ignore_conflicts(spark, sf_dir):
    """Owned paths that a pattern would hide."""
    return O.ignore_conflicts(_tree(spark, sf_dir)[1], PATTERNS)
