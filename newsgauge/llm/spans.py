"""Spans of regular expressions with code-point offsets, by SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def prefix_sums(values: Column) -> Column:
    """Sums of the values before each one, in blocks of the root of their number."""

    def blocked(v: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), lambda b: within(v, b))

    def within(v: Column, b: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil(F.size(v) / b).cast("int") - 1)
        blocks = F.transform(starts, lambda c: _sum(F.slice(v, c * b + 1, b)))
        offsets = let(blocks, lambda s: F.transform(starts, lambda c: _sum(F.slice(s, F.lit(1), c))))

        def each(o: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                c = F.floor(i / b).cast("int")
                return F.get(o, c) + _sum(F.slice(v, c * b + 1, i - c * b))

            return F.transform(v, one)

        return let(offsets, each)

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(blocked(v)))


def find(text: Column, kind: str, pattern: str, where: Column, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """The leftmost non-overlapping matches of pattern in a non-null text, those whose text passes keep.

    Matches and the text between them come from two passes of the same pattern, and
    their lengths add up to the offsets. where guards both: it must be true of every
    text that has a match worth keeping, and should be cheap. With a group, the span is
    that of the group, which begins where the match does and may reach beyond it.
    """
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    found = F.struct(*parts)

    def placed(x: Column) -> Column:
        gap, size = F.transform(x["g"], lambda g: F.length(g)), F.transform(x["m"], lambda m: F.length(m))

        def spans(gaps: Column) -> Column:
            both = F.transform(x["m"], lambda m, i: F.length(m) + F.get(gaps, i))

            def build(before: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    start = F.get(before, i) + F.get(gaps, i)
                    return F.struct(
                        F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value")
                    )

                every = F.transform(x["v" if group else "m"], span)
                return F.filter(every, lambda s: keep(s["value"])) if keep else every

            return let(prefix_sums(both), build)

        return let(gap, spans)

    return F.when(where, let(found, placed)).otherwise(F.array()).cast(SPAN)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))),
        ",",
    )


def ordered(spans: Column, kinds: list[str], by_kind_first: bool) -> Column:
    """Spans sorted by start then kind as listed, or the other way round."""
    place = F.array(*[F.lit(k) for k in kinds])

    def key(s: Column) -> Column:
        rank = F.array_position(place, s["kind"]).cast("int").alias("rank")
        first, second = (rank, s["start"].alias("at")) if by_kind_first else (s["start"].alias("at"), rank)
        return F.struct(first, second, s["end"].alias("stop"), s.alias("s"))

    return F.transform(F.array_sort(F.transform(spans, key)), lambda x: x["s"])


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
