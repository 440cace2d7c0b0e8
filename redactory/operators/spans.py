"""The span type, and what is done to arrays of spans: merging, filtering, counting."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from redactory.functions.arrays import batched, flat_of, lists, offsets_of
from redactory.functions.lexicon import COMMENT_RULES
from redactory.functions.predicates import rank_of

FIELDS = ("rule_id", "label", "severity", "category", "value", "start", "end")
#: Places are code points, the end is exclusive.
SPAN = "struct<rule_id:string,label:string,severity:string,category:string,value:string,start:int,end:int>"
SPANS = f"array<{SPAN}>"
Found = tuple[str, str, str, str, str, int, int]  # the fields of a span
KINDS = tuple(pa.int32() if n in ("start", "end") else pa.string() for n in FIELDS)


def span_lists(rows: Sequence[Sequence[Found]]) -> pa.ListArray:
    return lists(rows, FIELDS, KINDS)


def merged(structural: Sequence[Found], contextual: Sequence[Found], late: Sequence[Found] = ()) -> list[Found]:
    """merge() of one text's spans."""
    ordered = sorted([(s[5], 0, i, s) for i, s in enumerate(structural)] + [(s[5], 1, i, s) for i, s in enumerate(contextual)])
    out: list[Found] = []
    for _, _, _, s in ordered:
        if not out or out[-1][6] <= s[5]:
            out.append(s)
    if not late:
        return out
    starts = [s[5] for s in out]
    for s in late:  # spans that are kept are disjoint and in order: the last that begins before the end of s decides
        i = bisect_left(starts, s[6])
        if not i or out[i - 1][6] <= s[5]:
            starts.insert(i, s[5])
            out.insert(i, s)
    return out


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(rule_id, label, severity, category, value, start, end) -> Column:
    return F.struct(*(x.alias(n) for n, x in zip(FIELDS, (rule_id, label, severity, category, value, start.cast("int"), end.cast("int")), strict=True)))


def merge(structural: Column, contextual: Column, late: Column | None = None) -> Column:
    """Disjoint spans in order of place.

    Spans are taken in order of start, at one start those of structural rules first, then in the order given; a span is kept if it
    overlaps none kept before. Late spans fill gaps only. Ends of kept spans increase, so one comparison decides.
    """
    late = no_spans() if late is None else late
    return batched(_merge, SPANS, structural, contextual, late)


def _merge(structural: pa.Array, contextual: pa.Array, late: pa.Array) -> pa.Array:
    layers = [flat_of(x) for x in (structural, contextual, late)]
    every = pa.concat_arrays([pa.StructArray.from_arrays([x.field(n) for n in FIELDS], names=list(FIELDS)) for x, _ in layers])
    first = np.cumsum([0, *(len(x) for x, _ in layers)])  # where each layer's spans begin
    start, end = (every.field(n).to_numpy(zero_copy_only=False).tolist() for n in ("start", "end"))
    kept, sizes = [], []
    for row in range(len(structural)):
        own = [range(f + int(at[row]), f + int(at[row + 1])) for f, (_, at) in zip(first, layers, strict=False)]
        got: list[int] = []
        for i in sorted([*own[0], *own[1]], key=start.__getitem__):  # in order of their layers at one start
            if not got or end[got[-1]] <= start[i]:
                got.append(i)
        if own[2]:
            starts = [start[i] for i in got]
            for i in own[2]:
                at = bisect_left(starts, end[i])
                if not at or end[got[at - 1]] <= start[i]:
                    starts.insert(at, start[i])
                    got.insert(at, i)
        kept += got
        sizes.append(len(got))
    return pa.ListArray.from_arrays(offsets_of(sizes), every.take(pa.array(kept, pa.int64())))


def without_rules(spans: Column, rule_ids: list[str]) -> Column:
    """Spans of other rules. It comes after merging: a rule that is off still keeps its place from others."""
    return F.filter(spans, lambda s: ~s["rule_id"].isin(rule_ids)) if rule_ids else spans


def outside_comments(spans: Column, comments: Column) -> Column:
    """Without spans that lie in a comment (array<struct<start, end>>), credentials of fixed form excepted."""
    inside = lambda s: F.exists(comments, lambda c: (s["start"] >= c["start"]) & (s["end"] <= c["end"]))
    return F.filter(spans, lambda s: s["rule_id"].isin(COMMENT_RULES) | ~inside(s))


def overlapping(spans: Column, start: Column, end: Column) -> Column:
    """Spans that touch a range."""
    return F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def highest(spans: Column) -> Column:
    """Rank of the severest span (0 to 2); null if there are none."""
    return F.array_max(F.transform(spans, lambda s: rank_of(s["severity"])))
