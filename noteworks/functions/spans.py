"""Regex matches with offsets, computed inside the row by JVM expressions.

Spark returns matched strings but no positions. The pieces between the matches come from ``split``
with the same pattern, so a running sum of gap and match lengths gives every offset. Nothing is
exploded and nothing is shuffled: a note never leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<match:string,start:int,end:int>>"


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_items(df: DataFrame, items: Column, alias: str, *keep: Column | str) -> DataFrame:
    """One row per array element. The outer form keeps the optimizer from inferring a size filter, which
    would be pushed below and compute an expensive array a second time."""
    return df.select(*keep, F.explode_outer(items).alias(alias)).where(F.col(alias).isNotNull())


def find_spans(text: Column, pattern: Column | str) -> Column:
    """All non-overlapping matches of ``pattern``, left to right; ``start`` is 0-based, ``end`` exclusive."""
    if not isinstance(pattern, str):
        return let(pattern, lambda p: _find_spans(text, p))
    return _find_spans(text, F.lit(pattern))


def _find_spans(text: Column, pat: Column) -> Column:
    pieces = F.arrays_zip(
        F.split(text, pat, -1).alias("gap"),
        F.regexp_extract_all(text, pat, F.lit(0)).alias("hit"),
    )

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["at"] + F.length(F.coalesce(piece["gap"], F.lit("")))
        stop = begin + F.length(F.coalesce(piece["hit"], F.lit("")))
        span = F.struct(piece["hit"].alias("match"), begin.alias("start"), stop.alias("end"))
        grown = F.when(piece["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(stop.alias("at"), grown.alias("out"))

    return F.when(F.rlike(text, pat), let(pieces, lambda p: _walk(p, step))).otherwise(no_spans())


STRIDE = 32


def _walk(pieces: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold ``pieces`` by ``step`` into spans. A list that grows by one is copied at every step, so the pieces are
    folded in short runs, and each run's spans are moved behind those before it."""
    zero = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(STRIDE)),
        lambda i: F.aggregate(F.slice(pieces, i, STRIDE), zero, step),
    )

    def joined(done: Column) -> Column:
        ends = F.aggregate(done, F.array(F.lit(0)), lambda e, r: F.concat(e, F.array(F.element_at(e, -1) + r["at"])))
        moved = let(ends, lambda e: F.transform(done, lambda r, i: F.transform(r["out"], lambda s: F.struct(
            s["match"].alias("match"), (s["start"] + F.get(e, i)).alias("start"), (s["end"] + F.get(e, i)).alias("end")))))
        return F.flatten(moved)

    return let(runs, joined)


# Marks that enclose matches while offsets are counted; such characters of the text itself are blotted out.
OPEN_MARK, CLOSE_MARK, BLOT = "\ue000", "\ue001", "\ufffd"


def marked_text(text: Column, pattern: str, group: int = 0) -> Column:
    """``text`` with what ``group`` of each match saw between the marks."""
    own = F.contains(text, F.lit(OPEN_MARK)) | F.contains(text, F.lit(CLOSE_MARK))
    bare = F.when(own, F.translate(text, OPEN_MARK + CLOSE_MARK, BLOT * 2)).otherwise(text)
    return F.regexp_replace(bare, F.lit(pattern), F.lit(f"{OPEN_MARK}${group}{CLOSE_MARK}"))


def marked_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """As ``find_spans`` for a literal pattern of any size, which is compiled once a task.

    The matches are marked in one pass and the marked text is cut at a plain character. With ``group`` a match is
    what that group saw; inside a lookahead it may overlap the next one, and the text itself stays where it is.
    """
    inserted = group > 0  # a lookahead consumes nothing, so its match is written in front of the text it saw
    marked = marked_text(text, pattern, group)

    def cut(pieces: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            hit = F.substring_index(piece, CLOSE_MARK, 1)
            stop = acc["at"] + F.length(hit)
            span = F.struct(hit.alias("match"), acc["at"].alias("start"), stop.alias("end"))
            rest = F.length(piece) - F.length(hit) - 1
            return F.struct(((acc["at"] if inserted else stop) + rest).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        first = F.length(F.get(pieces, F.lit(0)))
        return F.transform(_walk(F.slice(pieces, 2, F.size(pieces)), step), lambda s: F.struct(
            s["match"].alias("match"), (s["start"] + first).alias("start"), (s["end"] + first).alias("end")))

    return let(F.split(marked, OPEN_MARK, -1), lambda p: F.when(F.size(p) > 1, cut(p)).otherwise(no_spans()))


def marked_tails(text: Column, pattern: str) -> Column:
    """The places where group 1 of ``pattern``, a lookahead, sees something: ``match`` is what it saw, ``tail`` the
    text from there to the next place. No text is read twice, however many places there are."""
    bare = F.translate(text, OPEN_MARK + CLOSE_MARK, BLOT * 2)
    pieces = F.split(F.regexp_replace(bare, F.lit(pattern), F.lit(f"{OPEN_MARK}$1{CLOSE_MARK}")), OPEN_MARK, -1)

    def step(acc: Column, tail: Column) -> Column:
        stop = acc["at"] + F.length(tail)
        span = F.struct(tail.alias("match"), acc["at"].alias("start"), stop.alias("end"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def places(p: Column) -> Column:
        tails = _walk(F.transform(p, lambda x: F.substring_index(x, CLOSE_MARK, -1)), step)
        return F.slice(F.zip_with(p, tails, lambda x, t: F.struct(
            F.substring_index(x, CLOSE_MARK, 1).alias("match"), t["start"].alias("start"), t["match"].alias("tail"))), 2, F.size(p))

    none = F.array().cast("array<struct<match:string,start:int,tail:string>>")
    return let(pieces, lambda p: F.when(F.size(p) > 1, places(p)).otherwise(none))


BLOCK_CHARS = 1024


def blocks(text: Column) -> Column:
    """``text`` in blocks of equal length, for ``cut``: a place far behind is reached without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of the text that ``blocks`` cut up."""
    first = F.floor(start / BLOCK_CHARS).cast("int")
    last = F.floor(F.greatest(end - 1, start) / BLOCK_CHARS).cast("int")
    # By place: ``slice`` would copy the whole list each time.
    several = F.array_join(F.transform(F.sequence(first, last), lambda b: F.get(parts, b)), "")
    return F.substring(several, start - first * BLOCK_CHARS + 1, F.greatest(end - start, F.lit(0)))


def context(text: Column, start: Column, end: Column, width: int) -> Column:
    """The text from ``width`` characters before a span to ``width`` after it."""
    left = F.greatest(start - width, F.lit(0))
    return F.substring(text, left + 1, end + width - left)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def keep_disjoint(spans: Column, span_type: str) -> Column:
    """Walk ``spans`` in their given order and keep each one that touches none kept before."""
    return F.aggregate(
        spans,
        F.array().cast(span_type),
        lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(
            F.concat(kept, F.array(s))
        ),
    )


def keep_apart(spans: Column, meets: Callable[[Column, Column], Column]) -> Column:
    """Walk ``spans`` in their given order and keep each one that does not meet the one kept last. Only places are
    carried along, since the state is copied at every step."""

    def walk(given: Column) -> Column:
        def step(kept: Column, i: Column) -> Column:
            touch = F.coalesce(meets(F.get(given, F.get(kept, F.size(kept) - 1)), F.get(given, i)), F.lit(False))
            return F.when(touch, kept).otherwise(F.concat(kept, F.array(i)))

        places = F.aggregate(F.transform(given, lambda s, i: i), F.array().cast("array<int>"), step)
        return F.transform(places, lambda i: F.get(given, i))

    return let(spans, walk)


def replace_spans(text: Column, spans: Column) -> Column:
    """Rewrite ``text`` with ``spans`` (disjoint, sorted by start, each carrying ``label``) replaced."""

    def body(given: Column) -> Column:
        def rewrite(parts: Column) -> Column:
            before = F.transform(given, lambda s, i: F.concat(
                cut(parts, F.coalesce(F.get(given, i - 1)["end"], F.lit(0)), s["start"]), s["label"]))
            last = cut(parts, F.element_at(given, -1)["end"], F.length(text))
            return F.concat(F.array_join(before, ""), last)

        return let(blocks(text), rewrite)

    return let(spans, lambda s: F.when(F.size(s) > 0, body(s)).otherwise(text))
