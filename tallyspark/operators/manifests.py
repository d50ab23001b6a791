"""Many bundles' manifests as relations: what is wrong with each, and what is wrong first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.invariants import outside, union_all
from tallyspark.operators.records import fragments, three_set_mismatch
from tallyspark.sources.lineage import cut

#: Fixed values.
MODES = ["verified_extractive", "exploratory_synthesis"]
PUBLICATION_CLASSES = ["peer_reviewed", "press", "regulatory", "blog", "unknown"]


@dataclass(frozen=True)
class Manifests:
    """What bundles declare and hold; a bundle that lacks a field has null or no row there, and passes its checks.

    bundles: (bundle, policy_sha, decision_log, trace, trace_log, mode, header, header_leaf)
    files: (bundle, path, cid), what is there, with the content address of its bytes
    snapshots: (bundle, cid, path); ingests: (bundle, path, policy_sha)
    anchors: (bundle, name, fragment), the fragment as JSON
    attributes: (bundle, cid, publication_class, signed, signing_key, issuer_verified, issuer)
    decisions: (bundle, path, cid); traces: (bundle, path, trace, candidates, context)
    outputs: (bundle, output, trace, emitted_at, retrieved, injected, quoted)
    """

    bundles: DataFrame
    files: DataFrame
    snapshots: DataFrame
    ingests: DataFrame
    anchors: DataFrame
    attributes: DataFrame
    decisions: DataFrame
    traces: DataFrame
    outputs: DataFrame


def _found(df: DataFrame, number: int, subject: str | None, reason: str | Column) -> DataFrame:
    """(bundle, number, subject, reason) of the rows whose reason isn't null."""
    subject = F.lit("") if subject is None else F.coalesce(F.col(subject).cast("string"), F.lit(""))
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("bundle", F.lit(number).alias("number"), subject.alias("subject"), reason.alias("reason")).where("reason is not null")


def _empty(*names: str) -> Column:
    return F.exists(F.array(*[F.col(n).cast("string") for n in names]), lambda x: F.coalesce(F.length(x) == 0, F.lit(True)))


def manifest_faults(m: Manifests) -> DataFrame:
    """(bundle, number, subject, reason): every fault, with the number of the check that finds it.

    6 snapshots need a policy; 7 a snapshot's file is there and has its
    address; 8 an ingest record names the policy in force; 9 anchors are
    fragments; 10 an anchor's snapshot is there; 11 attributes belong to a
    snapshot, have a known class, a key where signed and an issuer where one
    is verified; 12 the decision log is there and decides on every source with
    attributes; 13 a trace needs a log; 14 the log is there and holds the
    trace once; 15 candidates with attributes are snapshots; 16 outputs are
    whole and have the sets that their trace gives; 17 outputs need a mode;
    18 it is one of MODES; 19 an extractive output quotes something; 20 the
    stored leaf is the SHA-256 of the header. Addresses and hex digests are
    compared without case. Repeated rows give repeated faults; a row whose
    bundle is null belongs to none and is left to a look at its own table.
    """
    # What many checks read is worked out once; else each of the union's branches would make it anew.
    bundles, paths = cut(m.bundles), cut(m.files.groupBy("bundle", "path").agg(F.min(F.lower("cid")).alias("found")))
    stored = cut(m.snapshots.join(paths, ["bundle", "path"], "left"))
    held = stored.select("bundle", "cid").distinct()
    have = cut(stored.select("bundle").distinct())
    has_file = paths.select("bundle", "path", F.lit(True).alias("there"))

    policies = bundles.where("policy_sha is not null").select("bundle", F.lower("policy_sha").alias("in_force"))
    drifted = m.ingests.join(policies, "bundle").where(F.lower("policy_sha") != F.col("in_force"))

    anchors = fragments(m.anchors, "fragment").withColumnRenamed("reason", "fault").withColumn("cid", F.col("fragment.source_cid"))
    lost = stored.where("found is null").select("bundle", "cid").distinct()

    attributes = cut(m.attributes)
    sources = attributes.join(held.withColumn("held", F.lit(True)), ["bundle", "cid"], "left")
    unknown = F.col("bundle").isNotNull() & ~F.coalesce(F.col("publication_class").isin(PUBLICATION_CLASSES), F.lit(False))
    unfit = (
        F.when(F.col("held").isNull(), "no snapshot")
        .when(unknown, "unknown class")
        .when(F.col("signed") & _empty("signing_key"), "signed without a key")
        .when(F.col("issuer_verified") & _empty("issuer"), "verified without an issuer")
    )

    logs = bundles.where("decision_log is not null").select("bundle", F.col("decision_log").alias("path"))
    decided = m.decisions.select("bundle", "path", "cid").distinct()
    undecided = attributes.select("bundle", "cid").distinct().join(logs.join(has_file, ["bundle", "path"], "left_semi"), "bundle").join(decided, ["bundle", "path", "cid"], "left_anti")

    traced = cut(bundles.where("trace_log is not null").select("bundle", "trace", F.col("trace_log").alias("path")).join(has_file, ["bundle", "path"], "left"))
    traces, outputs = cut(m.traces), cut(m.outputs)
    times = traces.groupBy("bundle", "path", "trace").agg(F.count(F.lit(1)).alias("times"))
    loaded = traced.join(times, ["bundle", "path", "trace"], "left")
    unloaded = F.when(F.col("there").isNull(), "no log").when(F.col("trace").isNotNull() & F.col("times").isNull(), "no trace").when(F.col("times") > 1, "ambiguous trace")

    own_traces = traces.join(traced.where("there").select("bundle", "path"), ["bundle", "path"], "left_semi")
    candidates = own_traces.join(bundles.select("bundle", "trace"), ["bundle", "trace"], "left_semi").select("bundle", F.explode("candidates").alias("cid")).distinct()
    astray = candidates.join(attributes.select("bundle", "cid"), ["bundle", "cid"], "left_semi").join(have, "bundle", "left_semi").join(held, ["bundle", "cid"], "left_anti")

    parts = ["output", "trace", "emitted_at", "retrieved", "injected", "quoted"]
    missing = F.exists(F.array(*[F.col(p).isNull() for p in parts]), lambda x: x)
    at = lambda c: F.struct("bundle", c)
    whole = outputs.where(~missing).withColumns({"output": at("output"), "trace": at("trace")})
    sets = three_set_mismatch(whole, own_traces.select(at("trace").alias("trace"), "candidates", "context"), "trace").select("output.*", "reason")

    modes = outputs.join(bundles.select("bundle", "mode"), "bundle")
    leaf = F.when(F.col("header_leaf").isNotNull() & ~F.coalesce(F.lower("header_leaf") == F.sha2("header", 256), F.lit(False)), "header differs")
    return union_all([
        _found(bundles.where("policy_sha is null").join(have, "bundle", "left_semi"), 6, None, "no policy"),
        _found(stored, 7, "cid", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.lower("cid"), "address differs")),
        _found(drifted, 8, "path", "another policy"),
        _found(anchors, 9, "name", F.col("fault")),
        _found(anchors.where("fault is null").join(lost, ["bundle", "cid"], "left_semi"), 10, "name", "source is missing"),
        _found(sources, 11, "cid", unfit),
        _found(logs.join(has_file, ["bundle", "path"], "left_anti"), 12, "path", "no log").unionByName(_found(undecided, 12, "cid", "no decision")),
        _found(bundles.where("trace is not null and trace_log is null"), 13, "trace", "no log named"),
        _found(loaded, 14, "trace", unloaded),
        _found(astray, 15, "cid", "candidate without a snapshot"),
        _found(outputs.where(missing), 16, "output", "missing field").unionByName(_found(sets, 16, "output", F.col("reason"))),
        _found(bundles.where("mode is null").join(outputs, "bundle", "left_semi"), 17, None, "no mode"),
        _found(outside(bundles.where("mode is not null"), "mode", MODES), 18, "mode", "unknown mode"),
        _found(modes.where((F.col("mode") == MODES[0]) & (F.coalesce(F.size("quoted"), F.lit(0)) <= 0)), 19, "output", "nothing quoted"),
        _found(bundles, 20, None, leaf),
    ])


def first_faults(bundles: DataFrame, faults: DataFrame) -> DataFrame:
    """(bundle, number, subject, reason, n_faults) of every bundle: its fault of the lowest number (then subject, then reason), nulls and 0 if it has none."""
    least = faults.groupBy("bundle").agg(F.min(F.struct("number", "subject", "reason")).alias("_first"), F.count(F.lit(1)).alias("n"))
    joined = bundles.select("bundle").distinct().join(least, "bundle", "left")
    return joined.select("bundle", "_first.number", "_first.subject", "_first.reason", F.coalesce("n", F.lit(0)).alias("n_faults"))
