"""Text profiles, sentences and containment."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise_ascii(text: Column) -> Column:
    """Case folded, punctuation out, white space collapsed: the exact profile for ASCII texts, as one expression."""
    bare = F.regexp_replace(F.lower(F.upper(text)), r"\p{P}", "")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def _profile(text: str | None, keep_punctuation: bool) -> str | None:
    if text is None:
        return None
    folded = unicodedata.normalize("NFC", text).casefold()
    if not keep_punctuation:
        folded = "".join(c for c in folded if not unicodedata.category(c).startswith("P"))
    return re.sub(r"\s+", " ", folded).strip()


@F.pandas_udf(StringType())
def normalise(text: pd.Series) -> pd.Series:
    """Composed, case folded, punctuation out, white space collapsed; exact for every script (Arrow batches)."""
    return text.map(lambda t: _profile(t, False))


@F.pandas_udf(StringType())
def normalise_citation(text: pd.Series) -> pd.Series:
    """Case folded with white space collapsed; punctuation stays."""
    return text.map(lambda t: _profile(t, True))


def _class(holds: Callable[[str], bool]) -> str:
    """The characters for which a test holds, as a regular expression's class of ranges."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and holds(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return _tree(ranges)


def _tree(ranges: list[list[int]]) -> str:
    """Ranges as nested classes, each half tried only within its own span, so that a character meets a few of them and not all."""
    if len(ranges) <= 3:
        return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"
    half = len(ranges) // 2
    return "[" + "".join(f"[\\x{{{part[0][0]:x}}}-\\x{{{part[-1][1]:x}}}&&{_tree(part)}]" for part in (ranges[:half], ranges[half:])) + "]"


@cache
def _classes() -> tuple[str, str, str, str, dict[str, str], dict[str, str]]:
    """Made from Python's own tables: what composition may act on, punctuation, white space, the characters that fold to several, case folding to one character and to several."""
    second = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    folds, longer = {}, {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if (parts := unicodedata.decomposition(c).split()) and len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
        if (folded := c.casefold()) != c:
            (folds if len(folded) == 1 else longer)[c] = folded
    unsettled = _class(lambda c: unicodedata.combining(c) > 0 or c in second or unicodedata.normalize("NFC", c) != c)
    return unsettled, _class(lambda c: unicodedata.category(c).startswith("P")), _class(str.isspace), _class(lambda c: c in longer), folds, longer


def profile(text: Column, keep_punctuation: bool = False) -> Column:
    """normalise(), or normalise_citation() with keep_punctuation: the exact profile for every script, in expressions wherever composition has nothing to do.

    A text without a combining mark, a jamo or another character that
    composition may change is composed already; it is folded, stripped of
    punctuation and collapsed in the JVM by tables made from Python's own, so
    both ways give the same. Only the other texts reach an Arrow worker, which
    gets null in place of all that don't need it. Null stays null.
    """
    unsettled, marks, blank, spread, folds, longer = _classes()
    # The expansion met most often has a plain replacement, the others go character by character where there are any.
    folded = F.replace(text, F.lit("\u00df"), F.lit("ss"))
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    folded = F.when(folded.rlike(spread), spelled).otherwise(folded)
    folded = F.translate(folded, "".join(folds), "".join(folds.values()))
    bare = folded if keep_punctuation else F.regexp_replace(folded, marks, "")
    settled = F.trim(F.regexp_replace(bare, f"{blank}+", " "))
    loose = text.rlike(unsettled)
    slow = (normalise_citation if keep_punctuation else normalise)(F.when(loose, text))
    return F.when(loose, slow).otherwise(settled)


def fold_ascii(text: Column) -> Column:
    """Case folded with white space collapsed, for ASCII texts."""
    return strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def holds(whole: Column, part: Column) -> Column:
    """Whether a non-empty part stands in the whole; null counts as no."""
    return F.coalesce((F.length(part) > 0) & F.contains(whole, part), F.lit(False))


def segments(text: Column) -> Column:
    """What stands between runs of . ! ? that touch no digit, stripped, without empty ones."""
    pieces = F.transform(F.split(text, r"(?<!\d)[.!?]+(?!\d)"), strip)
    return F.filter(pieces, lambda x: x != "")


#: A sentence ends with marks that touch no digit and are followed by white space.
SENTENCE_END = r"(?<!\d)[.!?]+(?!\d)\s+"


def sentences(text: Column) -> Column:
    """Array of (start, end, text): each sentence with its marks, white space inside collapsed, UTF-8 byte offsets.

    end is start plus the bytes of the collapsed text, so it falls short of
    the source's span where runs were collapsed.
    """
    marked = F.regexp_replace(text, f"({SENTENCE_END})", "$1\u0000")
    raw = F.split(marked, "\u0000")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,text:string>>").alias("found"))

    def step(done: Column, piece: Column) -> Column:
        shown = strip(F.regexp_replace(piece, r"(?U)\s+", " "))
        here = F.struct(done["at"].alias("start"), (done["at"] + F.octet_length(shown)).alias("end"), shown.alias("text"))
        return F.struct((done["at"] + F.octet_length(piece)).alias("at"), F.when(shown != "", F.array_append(done["found"], here)).otherwise(done["found"]).alias("found"))

    return F.aggregate(raw, start, step, lambda s: s["found"])


def nth(found: Column, index: int | Column) -> Column:
    """The element at an index from 0; out of range fails."""
    at = F.lit(index) if isinstance(index, int) else index
    return F.when((at < 0) | (at >= F.size(found)), F.raise_error(F.lit("no such element"))).otherwise(F.get(found, at))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two UTF-8 byte offsets."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
