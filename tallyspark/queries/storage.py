"""Files written from the tables and read back: bundles, the content store, sealed copies, ranges of binary files."""

import uuid

from pyspark.sql import functions as F

from tallyspark.queries import query
from tallyspark.sources import bundles as B
from tallyspark.sources.lineage import shared_folder
from tallyspark.sources.ranges import read_fixed_width
from tallyspark.sources.tables import dealt, table


def _new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT CASE WHEN doc_id % 10 = 3 THEN 'spec/' ELSE 'docs/' || doc_id % 16 || '/' END || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, 'sound' AS state FROM documents
""")
def q_bundle_write(spark, sf_dir):
    """Every document as a file of one bundle; what its manifest says, beside what lies there."""
    folder = F.when(F.col("doc_id") % 10 == 3, "spec/").otherwise(F.concat(F.lit("docs/"), (F.col("doc_id") % 16).cast("string"), F.lit("/")))
    files = table(spark, sf_dir, "documents").select(F.concat(folder, F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    root = _new_folder(spark, "bundle")
    B.write_bundle(dealt(files), root, {"schema_version": "1"})
    sizes = B.listing(spark, root).where("kind = 'file'").select("path", "size")
    state = F.coalesce("fault", F.lit("sound"))
    return B.read_manifest(spark, root).join(sizes, "path").join(B.bundle_faults(spark, root), "path", "left").select("path", "sha256", "size", state.alias("state"))


@query("""
WITH c AS (SELECT DISTINCT l_shipmode AS t FROM (SELECT p_type || ' of size ' || p_size AS l_shipmode FROM part))
SELECT 'sha256:' || sha256(t) AS cid, 'sha256/' || left(sha256(t), 2) || '/' || sha256(t) AS path, CAST(strlen(t) AS BIGINT) AS size, t AS content FROM c
""")
def q_content_store(spark, sf_dir):
    """Kinds of parts, many of them equal, put into the store twice and read back by address."""
    contents = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" of size "), F.col("p_size").cast("string")).alias("content"))
    root = _new_folder(spark, "store")
    B.put_all(contents, root)
    put = B.put_all(contents, root)
    held = B.stored(spark, root).join(put.select("cid", "size"), "cid")
    return B.get_all(held, root).select("cid", "path", "size", F.col("content").cast("string").alias("content"))


@query("""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(round(value * 100) AS BIGINT) % 30000 - 7 AS v FROM events
""")
def q_binary_ranges(spark, sf_dir):
    """Each user's values as a file of 16-bit samples, sealed, and read back in ranges of 128 bytes."""
    v = F.col("v")
    byte = lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.round(F.col("value") * 100).cast("long") % 30000 - 7).alias("v"))
    samples = F.struct("ts", "event_id", F.concat(byte(v), byte(F.shiftright(v, 8))).alias("x"))
    files = e.groupBy("user_id").agg(F.array_sort(F.collect_list(samples)).alias("s"))
    content = F.unhex(F.array_join(F.transform("s", lambda s: s["x"]), ""))
    root = _new_folder(spark, "samples")
    B.write_bundle(dealt(files.select(F.concat(F.lit("pcm/"), F.col("user_id").cast("string"), F.lit(".bin")).alias("path"), content.alias("content"))), root)
    B.sealed_copy(B.listing(spark, root).where("kind = 'file' AND path LIKE 'pcm/%'"), root, f"{root}-sealed")
    read = read_fixed_width(spark, f"{root}-sealed/pcm", 2, range_bytes=128)
    return read.select(F.replace("path", F.lit(".bin"), F.lit("")).cast("long").alias("user_id"), "i", "v")
