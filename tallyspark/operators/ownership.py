"""Which of a tree's paths belong to whom: owners by path, by folder and by name, patterns to ignore, sealed trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILD = "*?["


def checked(patterns: list[str]) -> list[str]:
    """The patterns, if each is a relative file pattern that begins with a literal; else ValueError."""
    for p in patterns:
        faults = {
            "is empty or no string": not isinstance(p, str) or not p,
            "has a backslash": "\\" in str(p),
            "begins or ends with a slash": str(p).startswith("/") or str(p).endswith("/"),
            "climbs": ".." in str(p).split("/"),
            "is recursive": "**" in str(p),
            "doesn't begin with a literal": str(p)[:1] in WILD,
        }
        found = [name for name, is_so in faults.items() if is_so]
        if found:
            raise ValueError(f"pattern {p!r} {found[0]}")
    return patterns


def _piece(text: str) -> str:
    """A run without stars as a regular expression: ? is one character, [..] one of a set."""
    out, at = "", 0
    while at < len(text):
        c, at = text[at], at + 1
        close = text.find("]", at + (2 if text[at : at + 1] == "!" else 1)) if c == "[" else -1
        if c == "?":
            out += "."
        elif close >= 0:
            inner, at = text[at:close], close + 1
            out += "[" + ("^" if inner[0] == "!" else "") + re.sub(r"([\\\[\]&^])", r"\\\1", inner.removeprefix("!")) + "]"
        else:
            out += re.sub(r"([^A-Za-z0-9_/ ])", r"\\\1", c) if ord(c) < 128 else c
    return out


def glob_regex(pattern: str) -> str:
    """The whole-path regular expression of a glob whose * also stands for slashes; a star before more text stops at its first end, for good, so no path is tried in more than linear time a star."""
    head, *rest = pattern.split("*")
    body = _piece(head)
    for i, part in enumerate(rest):
        last = i == len(rest) - 1
        body += f".*{_piece(part)}" if last else f"(?>.*?{_piece(part)})"
    return rf"(?s)\A{body}\z"


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """The first pattern, in the order given, that a path matches; null if none.

    Patterns are kept by the first segment of the path where that is literal:
    a path is tried only against those of its own and those without one.
    """
    by_segment: dict[str | None, list[int]] = {}
    for i, p in enumerate(checked(patterns)):
        segment = p.split("/")[0]
        by_segment.setdefault(segment if "/" in p and not set(segment) & set(WILD) else p if not set(p) & set(WILD) else None, []).append(i)
    test = lambda i: F.when(path == patterns[i] if not set(patterns[i]) & set(WILD) else path.rlike(glob_regex(patterns[i])), F.lit(i))
    of = lambda numbers: F.coalesce(*[test(i) for i in numbers], F.lit(None).cast("int"))
    loose = of(by_segment.get(None, []))
    own, first = None, F.substring_index(path, "/", 1)
    for segment, numbers in by_segment.items():
        # An exact path stands under the whole of itself, which is its first segment if it has no slash.
        if segment is not None:
            own = F.when(first == segment, of(numbers)) if own is None else own.when(first == segment, of(numbers))
    at = loose if own is None else F.least(own, loose)
    return F.get(F.array(*[F.lit(p) for p in patterns]), at) if patterns else F.lit(None).cast("string")


def ignore_conflicts(owners: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, pattern): declared paths that a pattern would hide; a pattern may only cover what nobody owns."""
    matched = F.filter(F.array(*[F.when(F.col("path").rlike(glob_regex(p)), F.lit(p)) for p in checked(patterns)]), lambda p: p.isNotNull())
    return owners.select("path").distinct().select("path", F.explode(matched if patterns else F.array().cast("array<string>")).alias("pattern"))


def conserve(paths: DataFrame, owners: DataFrame, priority: list[str], trees: dict[str, str] | None = None, names: dict[str, str] | None = None, ignore: list[str] | None = None, sealed: bool = False) -> DataFrame:
    """(path, owner, pattern) with exactly one owner for each path.

    paths: (path), and entry (`file`, `link` or another kind) where known;
    owners: (path, kind); trees: kinds of all below a folder; names: kinds of
    files of that name anywhere. The first kind in priority order wins,
    wherever it comes from. Without an owner a path is IGNORED if a pattern
    matches it (which pattern says) and UNOWNED if none does; in a sealed tree
    nothing is ignored. Entries that are neither files nor links are IRREGULAR,
    whoever owns them. Kinds outside priority own nothing, a null path is
    UNOWNED, repeated paths count once (as irregular if one of them is).
    """
    rank = lambda kind: priority.index(kind) + 1 if kind in priority else None
    entry = F.col("entry") if "entry" in paths.columns else F.lit("file")
    seen = paths.groupBy("path").agg(F.max(~F.coalesce(entry, F.lit("file")).isin("file", "link")).alias("irregular"))
    kinds = F.array(*[F.lit(k) for k in priority])
    place = F.array_position(kinds, F.col("kind")).cast("int")
    held = owners.where(place > 0).groupBy("path").agg(F.min(place).alias("by_path"))
    below = [F.when(F.startswith("path", F.lit(folder.rstrip("/") + "/")), F.lit(rank(kind))) for folder, kind in (trees or {}).items() if rank(kind)]
    called = [F.when(F.substring_index("path", "/", -1) == name, F.lit(rank(kind))) for name, kind in (names or {}).items() if rank(kind)]
    none = F.lit(None).cast("int")
    best = F.least(F.col("by_path"), none, *below, *called)
    pattern = ignored_by(F.col("path"), [] if sealed else ignore or [])
    ruled = seen.join(held, "path", "left").withColumn("best", best).withColumn("pattern", F.when(F.col("best").isNull() & ~F.col("irregular"), pattern))
    owner = F.when(F.col("irregular"), "IRREGULAR").when(F.col("best").isNotNull(), F.get(kinds, F.col("best") - 1)).when(F.col("pattern").isNotNull(), "IGNORED")
    return ruled.select("path", F.coalesce(owner, F.lit("UNOWNED")).alias("owner"), "pattern")
