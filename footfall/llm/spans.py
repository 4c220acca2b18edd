"""Spans of pattern matches in texts, as column expressions.

Spans are counted in code points, end exclusive.  Patterns here repeat possessively and are
anchored to the start of a run, so that a very long text costs time in proportion and no
stack; they find what the plain patterns in the docstrings of their users find.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from footfall.llm.common import let

BLOCK = 64
NO_SPANS = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def find(text: Column, pattern: str, context: int = 24, needs: str | None = None) -> Column:
    """Leftmost matches that do not overlap: ``start, end, text, before, after``.

    ``before`` and ``after`` are up to ``context`` characters up to the neighbouring matches.
    Texts without the substring ``needs`` are not searched.
    """
    nothing = F.array().cast(NO_SPANS)
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)

    def spans(found: Column) -> Column:
        return F.when(F.size(found) == 0, nothing).otherwise(
            let(F.split(text, pattern, -1), lambda gaps: _placed(_measured(found, gaps, context)))
        )

    searched = let(matches, spans)
    return F.when(F.contains(text, F.lit(needs)), searched).otherwise(nothing) if needs else searched


def _measured(found: Column, gaps: Column, context: int) -> Column:
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.length(gaps[i]).alias("gap"), F.length(m).alias("size"), m.alias("text"),
            F.right(gaps[i], F.lit(context)).alias("before"), F.left(gaps[i + 1], F.lit(context)).alias("after"),
        ),
    )


def _placed(rows: Column) -> Column:
    """Running positions, by blocks: a sum over all earlier matches would be quadratic."""

    def width(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda total, r: total + r["gap"] + r["size"])

    def placed_in(block: Column, base: Column) -> Column:
        return F.transform(
            block,
            lambda r, j: let(
                base + width(F.slice(block, 1, j)) + r["gap"],
                lambda start: F.struct(
                    start.alias("start"), (start + r["size"]).alias("end"), r["text"].alias("text"),
                    r["before"].alias("before"), r["after"].alias("after"),
                ),
            ),
        )

    def over_blocks(blocks: Column) -> Column:
        return let(
            F.transform(blocks, width),
            lambda widths: F.flatten(
                F.transform(
                    blocks,
                    lambda block, i: let(
                        F.aggregate(F.slice(widths, 1, i), F.lit(0), lambda a, b: a + b),
                        lambda base: placed_in(block, base),
                    ),
                )
            ),
        )

    return let(
        rows,
        lambda rs: let(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(rs) - 1) / BLOCK).cast("int")),
                lambda b: F.slice(rs, b * BLOCK + 1, BLOCK),
            ),
            over_blocks,
        ),
    )


def of_kinds(kinds: Sequence[tuple[str, Callable[[Column], Column]]], text: Column) -> Column:
    """One array ``start, kind, end`` of the spans of all kinds, by start, then kind's place."""

    def named(spans: Column, kind: int) -> Column:
        return F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
        )

    return F.array_sort(F.concat(*[named(find_kind(text), kind) for kind, (_, find_kind) in enumerate(kinds)]))


def written(spans: Column, names: Sequence[str]) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ","
    )


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
