"""Positions of regex matches with DataFrame functions only.

Spans count code points from 0, the end is exclusive. A text's matches and the pieces
between them (the same regex, as separator) give the positions. A text without a match
is read once, another one three times (test, matches, pieces). Running sums go in two
levels of CHUNK values, so that the time follows a text's length, not its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
#: Values that one accumulator gathers; a text of n spans costs about n * (CHUNK + n / CHUNK**2).
CHUNK = 64
_FAR = 2**31 - 1


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _chunks(values: Column) -> Column:
    """The values in arrays of CHUNK, in order (one empty array for none)."""

    def cut(v: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))

    return let(values, cut)


def _running(values: Column, start: Column, join: Callable[[Column, Column], Column]) -> Column:
    first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, first, step, lambda acc: acc["out"])


def scan(values: Column, join: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """What an associative ``join`` makes of the int values before each one."""
    none = F.lit(zero)

    def both(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, none, join))
        return F.flatten(F.zip_with(chunks, _running(totals, none, join), lambda c, s: _running(c, s, join)))

    return let(_chunks(values), both)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _placed(found: Column, pieces: Column) -> Column:
    gaps = F.transform(F.slice(pieces, 1, F.size(found)), lambda p: F.length(p))
    sizes = F.transform(found, lambda m: F.length(m))

    def spans(x: Column) -> Column:
        before = scan(F.zip_with(x["gaps"], x["sizes"], _plus), _plus)
        rows = F.arrays_zip(before.alias("before"), x["gaps"].alias("gap"), x["sizes"].alias("size"), x["found"].alias("text"))
        start = lambda r: r["before"] + r["gap"]
        return F.transform(rows, lambda r: F.struct(start(r).alias("start"), (start(r) + r["size"]).alias("end"), r["text"].alias("text")))

    return let(F.struct(gaps.alias("gaps"), sizes.alias("sizes"), found.alias("found")), spans)


def matches(text: Column, pattern: str, maybe: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of ``text``, in order, as SPAN.

    ``maybe``, where given, is a cheap condition without which there is no match.
    The pattern must not match the empty string.
    """
    empty = F.array().cast(SPAN)
    spans = F.when(text.rlike(pattern), _placed(*_cut(text, pattern))).otherwise(empty)
    return spans if maybe is None else F.when(maybe, spans).otherwise(empty)


def matches_between(text: Column, pattern: str, piece: Callable[[Column], Column], kind: str) -> Column:
    """struct<spans: SPAN, between: array<kind>>: the matches, and ``piece`` of the text
    before the first, between each two and behind the last one (no match: no piece)."""

    def parts(x: Column) -> Column:
        return F.struct(_placed(x["found"], x["pieces"]).alias("spans"), F.transform(x["pieces"], piece).alias("between"))

    found, pieces = _cut(text, pattern)
    none = F.struct(F.array().cast(SPAN).alias("spans"), F.array().cast(f"array<{kind}>").alias("between"))
    return F.when(text.rlike(pattern), let(F.struct(found.alias("found"), pieces.alias("pieces")), parts)).otherwise(none)


def tagged(kind: str, spans: Column) -> Column:
    """The spans as array<struct<kind,start,end,text>>."""
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))


def joined(spans: Column) -> Column:
    """kind:start:end of tagged spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def overlapping(spans: Column, others: Column) -> Column:
    """For each span (in order, none starting where another one does) whether one of the
    others overlaps it. Both are walked once, sorted by start."""

    def flags(events: Column) -> Column:
        other = lambda e: e["own"] == 0
        reached = scan(F.transform(events, lambda e: F.when(other(e), e["end"]).otherwise(0)), _most)
        ahead = F.reverse(scan(F.reverse(F.transform(events, lambda e: F.when(other(e), e["start"]).otherwise(_FAR))), _least, _FAR))
        rows = F.filter(F.arrays_zip(events.alias("e"), reached.alias("reached"), ahead.alias("ahead")), lambda r: r["e"]["own"] == 1)
        return F.transform(rows, lambda r: (r["reached"] > r["e"]["start"]) | (r["ahead"] < r["e"]["end"]))

    place = lambda own: lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"))
    events = F.array_sort(F.concat(F.transform(others, place(0)), F.transform(spans, place(1))))
    clear = F.transform(spans, lambda x: F.lit(False))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), clear).otherwise(let(events, flags))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    rows = F.arrays_zip(spans.alias("span"), overlapping(spans, others).alias("hit"))
    return F.transform(F.filter(rows, lambda r: ~r["hit"]), lambda r: r["span"])


def masked(text: Column, spans: Column) -> Column:
    """The text with each tagged span replaced by <KIND>; of overlapping spans the
    first to start counts, and what others cover beyond it goes with it."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def write(part: Column) -> Column:
        """The text of one chunk, cut from it rather than from the whole."""
        mark = lambda r: F.when(r["s"]["start"] >= r["at"], F.concat(F.lit("<"), F.upper(r["s"]["kind"]), F.lit(">"))).otherwise("")
        kept = lambda r: F.substr(part["text"], r["at"] - part["at"] + 1, F.greatest(r["s"]["start"] - r["at"], F.lit(0)))
        return F.array_join(F.transform(part["rows"], lambda r: F.concat(kept(r), mark(r))), "")

    def chunk(rows: Column) -> Column:
        low = rows[0]["at"]
        high = F.array_max(F.transform(rows, lambda r: F.greatest(r["s"]["start"], r["at"])))
        return F.struct(low.alias("at"), F.substr(text, low + 1, high - low).alias("text"), rows.alias("rows"))

    def whole(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["end"])
        chunks, end = _chunks(F.arrays_zip(s.alias("s"), scan(ends, _most).alias("at"))), F.array_max(ends)
        return F.concat(F.array_join(F.transform(F.transform(chunks, chunk), write), ""), F.substr(text, end + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, whole))
