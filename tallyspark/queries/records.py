"""Replayed records, canonical JSON, fragments, traces and manifests."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import records as C
from tallyspark.queries import query
from tallyspark.sources.tables import table


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
o AS (SELECT *, CASE WHEN user_id % 53 = 1 THEN 'AMEND' WHEN n = 1 THEN 'CREATE' WHEN n = 3 AND user_id % 50 = 2 THEN 'CREATE' WHEN n = 4 AND user_id % 41 = 0 THEN 'RENAME' WHEN n % 10 = 0 THEN 'LOG' ELSE 'AMEND' END AS op FROM e),
s AS (SELECT user_id, CASE WHEN sum((op = 'RENAME')::INT) > 0 THEN 'unknown operation' WHEN sum((op = 'CREATE')::INT) = 0 THEN 'no create' WHEN sum((op = 'CREATE')::INT) > 1 THEN 'second create' ELSE 'replayed' END AS status FROM o GROUP BY 1),
f AS (SELECT user_id, event_type, arg_max(struct_pack(v := CASE WHEN c % 7 <> 0 THEN CAST(c AS VARCHAR) END), n) AS l FROM o WHERE op IN ('CREATE', 'AMEND') GROUP BY 1, 2),
j AS (SELECT user_id, '{' || string_agg('"' || event_type || '":' || coalesce('"' || l.v || '"', 'null'), ',' ORDER BY event_type) || '}' AS state FROM f GROUP BY 1)
SELECT user_id, status, CASE WHEN status = 'replayed' THEN state END AS state, CASE WHEN status = 'replayed' THEN sha256(state) END AS digest FROM s LEFT JOIN j USING (user_id)
""")
def q_record_replay(spark, sf_dir):
    """Each user's events as a log of one record, with some logs broken."""
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    n, user, c = F.col("n"), F.col("user_id"), F.round(F.col("value") * 100).cast("long")
    op = F.when(user % 53 == 1, "AMEND").when(n == 1, "CREATE").when((n == 3) & (user % 50 == 2), "CREATE").when((n == 4) & (user % 41 == 0), "RENAME").when(n % 10 == 0, "LOG").otherwise("AMEND")
    patch = F.create_map("event_type", F.when(c % 7 != 0, c.cast("string")))
    return C.replay(e.select("user_id", "n", op.alias("op"), patch.alias("patch")), "user_id", ["n"], "op", "patch")


@query("""
SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || replace(p_name, 'widget', 'wid\\"get') || '","size":' || CASE WHEN p_size % 3 = 0 THEN 'null' ELSE '"' || p_size || '"' END || '}' AS canonical FROM part
""")
def q_canonical_json(spark, sf_dir):
    fields = F.create_map(F.lit("size"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")), F.lit("name"), F.replace("p_name", F.lit("widget"), F.lit('wid"get')), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", C.canonical_json(fields).alias("canonical"))


@query("""
SELECT p_partkey, '{' || CASE WHEN p_size % 2 = 0 THEN 'a:x=1,y=2,z=9' ELSE 'a:x=1,y=2' END || ';b:k=' || p_size || CASE WHEN p_size % 2 = 0 THEN ';c:m=5' ELSE '' END || '}' AS merged FROM part
""")
def q_map_merge(spark, sf_dir):
    word = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))])
    even, size = F.col("p_size") % 2 == 0, F.col("p_size").cast("string")
    left = F.create_map(F.lit("a"), word(x="1", y="1"), F.lit("b"), word(k="0"))
    right = F.when(even, F.create_map(F.lit("b"), word(k=size), F.lit("a"), word(y="2", z="9"), F.lit("c"), word(m="5"))).otherwise(F.create_map(F.lit("a"), word(y="2"), F.lit("b"), word(k=size)))
    inner = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    outer = F.transform(F.array_sort(F.map_entries(F.transform_values(C.merge_maps(left, right), lambda _, v: inner(v)))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("{"), F.array_join(outer, ";"), F.lit("}")).alias("merged"))


@query("""
WITH a AS (SELECT DISTINCT l_suppkey, l_linenumber % 3 AS form FROM lineitem)
SELECT l_suppkey, form, CASE WHEN form < 2 THEN s_name END AS s_name, form < 2 AND s_name IS NOT NULL AS resolved FROM a LEFT JOIN supplier ON s_suppkey = l_suppkey
""")
def q_parallel_cites(spark, sf_dir):
    """Suppliers are known by number and by name; asserted citations use either, in loose spelling, or neither."""
    records = table(spark, sf_dir, "supplier").withColumn("cites", F.array(F.concat(F.lit("No. "), F.col("s_suppkey").cast("string")), F.concat(F.lit("Sup "), F.col("s_suppkey").cast("string")), F.concat(F.lit("no.  "), F.col("s_suppkey").cast("string"))))
    asserted = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 3).alias("form")).distinct()
    cite = F.concat(F.when(F.col("form") == 0, " NO.   ").when(F.col("form") == 1, "sup\t").otherwise("see "), F.col("l_suppkey").cast("string"))
    found = C.resolve_many(asserted.withColumn("cite", cite), records, "cite", "s_suppkey", "cites", ["s_name"])
    return found.select("l_suppkey", "form", "s_name", "resolved")


@query("""
WITH s AS (SELECT p_partkey, round(0.5::DOUBLE * p_size + 0.25::DOUBLE * p_retailprice, 6) AS score FROM part)
SELECT p_partkey, score, round(score * 0.75::DOUBLE, 6) AS low, round(score * 1.25::DOUBLE, 6) AS high FROM s
""")
def q_confidence_band(spark, sf_dir):
    scored = table(spark, sf_dir, "part").select("p_partkey", F.round(0.5 * F.col("p_size") + 0.25 * F.col("p_retailprice"), 6).alias("score"))
    low, high = C.confidence_band(F.col("score"), 0.75, 1.25)
    return scored.select("p_partkey", "score", low.alias("low"), high.alias("high"))


@query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'byte_offset' WHEN 1 THEN 'sentence_id' WHEN 2 THEN 'page_coord' WHEN 3 THEN 'timestamp_sample' WHEN 4 THEN 'opaque' WHEN 5 THEN 'rumour' WHEN 6 THEN NULL ELSE 'byte_offset' END AS kind,
  CASE p_partkey % 8 WHEN 0 THEN CASE WHEN 30 - p_size < 0 OR 10 <= 30 - p_size THEN 'out of bounds' END WHEN 1 THEN CASE WHEN p_size < 10 THEN 'out of bounds' END
  WHEN 2 THEN CASE WHEN p_size < 11 OR p_size <= 30 THEN 'out of bounds' END WHEN 3 THEN CASE WHEN p_size < 10 THEN 'out of bounds' END
  WHEN 4 THEN NULL WHEN 5 THEN 'unknown kind' WHEN 6 THEN 'no kind' ELSE 'missing field' END AS reason FROM part
""")
def q_fragments(spark, sf_dir):
    """Fragments of all kinds with bounds from p_size, some without a field or a known kind."""
    forms = [
        '{"kind":"byte_offset","source_cid":"c","start":%d,"end":10}', '{"kind":"sentence_id","source_cid":"c","sentence_index":%d}',
        '{"kind":"page_coord","source_cid":"c","page":%d,"x0":20.5,"y0":0,"x1":%d,"y1":1}', '{"kind":"timestamp_sample","source_cid":"c","timestamp_iso":"t","sensor_id":"s","sample_index":%d}',
        '{"kind":"opaque","source_cid":"c","kind_tag":"t","locator":{"n":"%d"}}', '{"kind":"rumour","start":%d}', '{"source_cid":"c","start":%d}', '{"kind":"byte_offset","source_cid":"c","start":%d}',
    ]
    size = F.col("p_size")
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        # The end of a byte range is 10 and its start 30 - p_size, so that a start below 0 or of 10 and more is out of bounds.
        at = [30 - size] if i == 0 else [size - 10]
        made = F.format_string(form, *(at if form.count("%d") == 1 else [*at, size - 10]))
        text = F.when(F.col("p_partkey") % 8 == i, made).otherwise(text)
    done = C.fragments(table(spark, sf_dir, "part").select("p_partkey", "p_size", text.alias("text")), "text")
    return done.select("p_partkey", "fragment.kind", "reason")


_TRACES = """WITH t AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS candidates, list_sort(list(DISTINCT CASE WHEN l_quantity > 10 THEN l_suppkey END) FILTER (l_quantity > 10)) AS big,
  list_sort(list(DISTINCT l_suppkey) FILTER (l_quantity > 25)) AS huge FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, candidates, coalesce(big, []) || CASE WHEN l_orderkey % 31 = 0 THEN [-1::BIGINT] ELSE [] END AS selected, coalesce(huge, []) || CASE WHEN l_orderkey % 37 = 0 THEN [-2::BIGINT] ELSE [] END AS context FROM t)
"""


def _traces(spark, sf_dir):
    """A retrieval trace per order, with some that hold what they may not."""
    gathered = lambda least: F.array_sort(F.collect_set(F.when(F.col("l_quantity") > least, F.col("l_suppkey").cast("long"))))
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(gathered(-1).alias("candidates"), gathered(10).alias("selected"), gathered(25).alias("context"))
    key = F.col("l_orderkey")
    none = F.array().cast("array<bigint>")
    return sets.withColumns({"selected": F.concat("selected", F.when(key % 31 == 0, F.array(F.lit(-1).cast("long"))).otherwise(none)), "context": F.concat("context", F.when(key % 37 == 0, F.array(F.lit(-2).cast("long"))).otherwise(none))})


@query(_TRACES + """SELECT l_orderkey, reason FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 41 = 0 THEN 'empty name' WHEN l_orderkey % 43 = 0 THEN 'score not finite'
  WHEN len(list_filter(selected, lambda x: NOT list_contains(candidates, x))) > 0 THEN 'selected not in candidates' WHEN len(list_filter(context, lambda x: NOT list_contains(selected, x))) > 0 THEN 'context not in selected' END AS reason FROM s) WHERE reason IS NOT NULL
""")
def q_trace_shape(spark, sf_dir):
    key = F.col("l_orderkey")
    named = _traces(spark, sf_dir).withColumns({"retriever": F.when(key % 41 == 0, "").otherwise("r1"), "scores": F.array(F.lit(0.5), F.when(key % 43 == 0, float("inf")).otherwise(1.0))})
    return C.trace_faults(named, "candidates", "selected", "context", "scores", ["retriever"]).select("l_orderkey", "reason")


@query(_TRACES + """SELECT l_orderkey AS output, reason FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 29 = 0 THEN 'no trace' WHEN l_orderkey % 37 = 0 THEN 'context not retrieved' WHEN l_orderkey % 23 = 0 THEN 'quote not in context'
  WHEN l_orderkey % 19 = 0 THEN 'stored differs' END AS reason FROM s) WHERE reason IS NOT NULL
""")
def q_three_set_derived(spark, sf_dir):
    key = F.col("l_orderkey")
    traces = _traces(spark, sf_dir).select(key.alias("trace"), "candidates", "context")
    quoted = F.when(key % 23 == 0, F.array(F.lit(-9).cast("long"))).otherwise(F.slice("context", 1, 1))
    retrieved = F.when(key % 19 == 0, F.array_append("candidates", F.lit(-3).cast("long"))).otherwise(F.col("candidates"))
    stored = _traces(spark, sf_dir).select(key.alias("output"), F.when(key % 29 != 0, key).alias("trace"), retrieved.alias("retrieved"), F.col("context").alias("injected"), quoted.alias("quoted"))
    return C.three_set_mismatch(stored, traces, "trace")


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'no such profile' ELSE 'above the ceiling' END AS reason FROM orders
WHERE o_orderpriority = '5-LOW' OR CAST(round(o_totalprice * 100) AS BIGINT) > CASE o_orderpriority WHEN '1-URGENT' THEN 10000000 WHEN '2-HIGH' THEN 20000000 ELSE 30000000 END
""")
def q_anchor_window(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("observed"))
    ceilings = {"1-URGENT": 10_000_000, "2-HIGH": 20_000_000, **{p: 30_000_000 for p in ("3-MEDIUM", "4-NOT SPECIFIED")}}
    return C.above_ceiling(orders, "o_orderpriority", "observed", ceilings).select("o_orderkey", "reason")


@query("""
SELECT p_partkey, 'versions differ' AS reason FROM part WHERE p_size % 4 = 1 UNION ALL SELECT p_partkey, 'banned field' FROM part WHERE p_brand IN ('Brand#13', 'Brand#22')
""")
def q_manifest_fields(spark, sf_dir):
    """Part rows as manifests: the version is right, absent, empty or another one; the brand is a field's name."""
    version = F.when(F.col("p_size") % 4 == 1, "v2").when(F.col("p_size") % 4 == 2, "").otherwise("v1")
    manifests = table(spark, sf_dir, "part").select("p_partkey", F.lit("v1").alias("header"), F.create_map(F.lit("schema_version"), version, F.col("p_brand"), F.lit("x")).alias("fields"))
    return C.manifest_fields(manifests, "fields", "header", ["Brand#13", "Brand#22"]).select("p_partkey", "reason")


@query("""
WITH g AS (SELECT item_id, item_id * 30 AS source, unnest([1, 2, 3]) AS part, text FROM benchmark),
s AS (SELECT item_id, source, part, CASE part WHEN 1 THEN substr(text, 1, 20) WHEN 2 THEN ' ' ELSE upper(substr(text, 21)) END AS text FROM g),
k AS (SELECT s.item_id, s.part, s.text FROM s JOIN documents d ON d.doc_id = s.source WHERE s.item_id % 3 <> 2 AND length(trim(regexp_replace(lower(s.text), '\\s+', ' ', 'g'))) > 0
  AND contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(s.text), '\\s+', ' ', 'g'))))
SELECT b.item_id, count(k.part) AS kept, coalesce(string_agg(k.text, '' ORDER BY k.part), '') AS text FROM benchmark b LEFT JOIN k ON k.item_id = b.item_id GROUP BY 1
""")
def q_extractive(spark, sf_dir):
    """Benchmark items as outputs of three segments, stamped with a document; two thirds of the outputs may quote it."""
    items = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 30).alias("source"), "text")
    parts = F.array(F.substring("text", 1, 20), F.lit(" "), F.upper(F.substring(F.col("text"), F.lit(21), F.length("text"))))
    segments = items.select("item_id", "source", F.posexplode(parts).alias("at", "text"))
    quotable = items.where("item_id % 3 <> 2")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("text").alias("whole"))
    return C.extractive(segments, docs.join(items.select("source"), "source", "left_semi"), "item_id", quotable)


@query("""
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY replace(path, '/', chr(1))) AS rank FROM (SELECT p_brand, p_partkey, p_type || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '-' END || p_partkey AS path FROM part)
""")
def q_path_order(spark, sf_dir):
    path = F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, "/").otherwise("-"), F.col("p_partkey").cast("string"))
    return C.path_order(table(spark, sf_dir, "part").select("p_brand", "p_partkey", path.alias("path")), "p_brand", "path").select("p_brand", "p_partkey", "rank")
