"""Spans of pattern matches in column expressions, at a cost linear in the text.

Higher-order functions have no local names, and an aggregate copies its whole state for each
element: `bound` gives a value a name, and `scan` combines numbers instead of growing arrays.
All of it is one expression: no Python in tasks, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose measures are combined before they become one of their block, and how often
#: blocks are combined likewise.
BLOCK, LEVELS = 32, 2


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(
    values: Column,
    measure: Callable[[Column], Column],
    combine: Callable[[Column, Column], Column],
    zero: Column,
    output: Callable[[Column, Column], Column],
) -> Column:
    """`output(state, element)` for every element of an array, in order.

    The state is the measures of all elements before, combined; `combine` is associative
    and `zero` changes nothing. Elements start from their block's state, blocks from that of
    theirs, and so on for `LEVELS` levels.
    """

    def folded(part: Column, start: Column) -> Column:
        return F.aggregate(part, start, lambda a, b: combine(a, b))

    def before(measures: Column, levels: int) -> Column:
        """For every element the measures before it."""
        if not levels:
            return F.transform(measures, lambda _, i: folded(F.slice(measures, F.lit(1), i), zero))
        last = F.greatest(F.floor((F.size(measures) - 1) / BLOCK).cast("int"), F.lit(0))
        totals = F.transform(
            F.sequence(F.lit(0), last), lambda b: folded(F.slice(measures, b * BLOCK + 1, BLOCK), zero)
        )

        def in_block(starts: Column) -> Callable[[Column, Column], Column]:
            def one(_: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                earlier = F.slice(measures, block * BLOCK + 1, i - block * BLOCK)
                return folded(earlier, F.get(starts, block))

            return one

        of_blocks = bound(totals, lambda sums: before(sums, levels - 1))
        return bound(of_blocks, lambda starts: F.transform(measures, in_block(starts)))

    def over(array: Column) -> Column:
        states = bound(F.transform(array, measure), lambda measures: before(measures, LEVELS))
        return F.zip_with(array, states, lambda x, state: output(state, x))

    return bound(values, over)


def located(text: Column, pattern: str, group: int, before: int = 0, after: int = 0) -> Column:
    """`(start, end, value, before, after)` of all matches, in code points.

    `value` is the match's part `group`; `before` and `after` are up to that many
    characters around it, as far as the next match.
    """
    kind = "struct<start:int,end:int,value:string,before:string,after:string>"
    gaps = F.transform(
        F.split(text, pattern, -1),
        lambda g: F.struct(
            F.length(g).alias("length"), F.left(g, F.lit(after)).alias("head"), F.right(g, F.lit(before)).alias("tail")
        ),
    )

    def placed(at: Column, piece: Column) -> Column:
        start = at + piece["gap"]["length"]
        return F.struct(
            start.alias("start"),
            (start + F.length(piece["match"])).alias("end"),
            piece["value"].alias("value"),
            piece["gap"]["tail"].alias("before"),
            piece["next"]["head"].alias("after"),
        )

    def zipped(parts: Column) -> Column:
        following = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.arrays_zip(
            parts.alias("gap"),
            following.alias("next"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        )

    taken = lambda piece: piece["gap"]["length"] + F.coalesce(F.length(piece["match"]), F.lit(0))
    spans = scan(bound(gaps, zipped), taken, lambda a, b: a + b, F.lit(0), placed)
    # The last gap has no match and gives a span without an end.
    found = F.filter(spans, lambda m: m["end"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def written(spans: Column, kinds: Sequence[str]) -> Column:
    """`kind:start:end` of all spans, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    )
    return F.array_join(parts, ",")
