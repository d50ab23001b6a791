"""URL filters: rules by host and path, and a tree of path templates per host judged by labelled purity.

Everything here is a Spark SQL expression. URLs collapse to shapes (numbers
out) before the tree is built, and the tree is built level by level over
shapes, so a host with a third of all pages is small there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm._common import columns_free_of, write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands for a run of digits, a wildcard segment, and all segments below the last level of the tree.
NUMBER, ANY, REST = "{n}", "*", "**"
#: Levels of the tree; a path's further segments are one wildcard.
DEPTH = 4
#: A segment keeps its own branch only with at least this part of its parent's pages (so a parent has at most so many branches).
BRANCHES = 16
#: Its rate of bad labels must differ from its siblings' by a chi-square of at least this (one degree of freedom, 5 %).
CHI = 3.841
#: Weight, in labelled pages, of a host's rate on its templates and of the overall rate on a host.
PRIOR = 4.0
#: A template whose smoothed share of bad labels is at least this is rejected.
REJECT = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z in lower case; empty without ://, or for null."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*+", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*+([^?#]*+)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the longest rule (host, path, verdict) that fits; null where none does.

    A rule fits its host and all hosts below it, where the path begins with
    its own. Rules of equal length go by their text.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grow(nodes: DataFrame, level: int) -> DataFrame:
    """Adds one segment to each template: its own text where the branch stands apart, else a wildcard shared with its siblings.

    A branch stands apart if it is its parent's only one, or if it has its
    part of the pages and its bad labels differ from its siblings'. All
    others are merged; a path that ends here has no segment to add.
    """
    segment = F.get("segments", F.lit(level))
    sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "bad")]
    children = nodes.where(segment.isNotNull()).groupBy("host", "template", segment.alias("segment")).agg(*sums)
    parents = children.groupBy("host", "template").agg(F.sum("pages").alias("all_pages"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("branches"))
    n, b, others, others_bad = F.col("labelled"), F.col("bad"), F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    # Chi-square of the two by two table of own and siblings' labels, products kept apart from the quotient: no division by zero.
    cross = (b * (others - others_bad) - others_bad * (n - b)).cast("double")
    margins = n.cast("double") * others * F.col("all_bad") * (F.col("all_labelled") - F.col("all_bad"))
    apart = (margins > 0) & (cross * cross * F.col("all_labelled") >= F.lit(CHI) * margins)
    own = (F.col("branches") == 1) | ((F.col("pages") * BRANCHES >= F.col("all_pages")) & apart)
    kept = children.join(parents, ["host", "template"]).where(own)
    kept = kept.select(F.col("host").alias("of_host"), F.col("template").alias("of_template"), F.col("segment").alias("of_segment"))
    nodes = nodes.withColumn("segment", segment)
    keys = (F.col("host") == F.col("of_host")) & (F.col("template") == F.col("of_template")) & (F.col("segment") == F.col("of_segment"))
    added = F.when(F.col("of_segment").isNotNull(), F.col("segment")).otherwise(ANY)
    grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), added))
    return nodes.join(kept, keys, "left").select("host", "shape", "segments", grown.alias("template"), "pages", "labelled", "bad")


def templates(shapes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, shape, template, purity) of shapes (host, shape, pages, labelled, bad): the tree, and each template's smoothed share of bad labels."""
    nodes = shapes.withColumns({"segments": F.slice(F.split("shape", "/"), 2, 1 << 30), "template": F.lit("")})
    for level in range(depth):
        nodes = write_table(_grow(nodes, level)).rows
    named = F.when(F.size("segments") > depth, F.concat("template", F.lit("/" + REST))).otherwise(F.col("template"))
    nodes = nodes.withColumn("template", named)
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    of = nodes.groupBy("host", "template").agg(*sums)
    every = nodes.agg(*sums).first()
    rate = every["bad"] / every["labelled"] if every["labelled"] else 0.0
    host_rate = (F.sum("bad") + PRIOR * rate) / (F.sum("labelled") + PRIOR)
    of_host = of.groupBy("host").agg(host_rate.alias("host_rate"))
    purity = (F.col("bad") + PRIOR * F.col("host_rate")) / (F.col("labelled") + PRIOR)
    judged = of.join(of_host, "host").select("host", "template", purity.alias("purity"))
    return nodes.select("host", "shape", "template").join(judged, ["host", "template"])


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", bad: str = "bad") -> DataFrame:
    """pages' columns with host, path, rule, template, purity and verdict (allow or block); added names get underscores where taken.

    labels has page_id and bad (boolean); null labels count as none, a page
    with several counts as bad if one is. A rule's verdict comes first;
    without one, a page is blocked if its template's smoothed share of bad
    labels is at least a half. A null or odd URL has an empty host and path
    and is judged like others; without any label nothing is blocked by its
    template. Rows that repeat an id are judged each by its URL, and its label
    counts for each. No pages give no rows.
    """
    names = columns_free_of(pages, "host", "path", "rule", "template", "purity", "verdict", "shape")
    host, path, rule, template, purity, verdict, shape = names
    parsed = pages.withColumns({host: F.coalesce(host_of(F.col(url)), F.lit("")), path: F.coalesce(path_of(F.col(url)), F.lit(""))})
    parsed = parsed.withColumn(shape, F.regexp_replace(path, "[0-9]++", NUMBER.replace("{", r"\{")))
    known = labels.where(F.col(bad).isNotNull() & F.col(page_id).isNotNull()).groupBy(F.col(page_id).alias("_page")).agg(F.max(bad).alias("_bad"))
    counted = parsed.select(F.col(page_id).alias("_id"), F.col(host).alias("host"), F.col(shape).alias("shape")).join(known, F.col("_id") == F.col("_page"), "left")
    shapes = counted.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count("_bad").alias("labelled"), F.sum(F.coalesce(F.col("_bad").cast("int"), F.lit(0))).alias("bad"))
    tree = templates(shapes).select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), F.col("template").alias("_template"), F.col("purity").alias("_purity"))
    joined = parsed.join(tree, (F.col(host) == F.col("_host")) & (F.col(shape) == F.col("_shape")))
    which, says = rule_for(F.col(host), F.col(path), rules)
    by_tree = F.when(F.col("_purity") >= REJECT, "block").otherwise("allow")
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], host, path, which.alias(rule), F.col("_template").alias(template), F.col("_purity").alias(purity), F.coalesce(says, by_tree).alias(verdict))
