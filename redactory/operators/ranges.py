"""Parts of texts: highlighting as an editor shows it, and redacting a range."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.arrays import batched, strings
from redactory.operators.redact import anonymize
from redactory.operators.scan import OFFLINE, ScanConfig, scan_text
from redactory.operators.spans import SPANS, Found, span_lists


def highlighted(text: str, config: ScanConfig = OFFLINE) -> list[Found]:
    """Spans of all detectors line by line, rules that are off left out first; one that begins inside the span listed before it isn't shown."""
    found = scan_text(text, config)
    ordered = sorted((s for s in (*found.structural, *found.context) if s[0] not in config.disabled), key=lambda s: s[5])
    return [s for i, s in enumerate(ordered) if not i or s[5] >= ordered[i - 1][6]]


def in_range(text: str, start: int, end: int, config: ScanConfig = OFFLINE) -> list[Found]:
    """Spans that touch a range. The whole lines around it are read, since values are often known by the words beside them."""
    start, end = max(0, start), min(len(text), end)
    low, high = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    found = scan_text(text[low : high if high >= 0 else len(text)], config).spans(config)
    return [(*s[:5], s[5] + low, s[6] + low) for s in found if s[5] + low < end and s[6] + low > start]


def _highlights(config: ScanConfig, texts: pa.Array) -> pa.Array:
    return span_lists([highlighted(t, config) for t in strings(texts)])


def highlights(text: Column, config: ScanConfig = OFFLINE) -> Column:
    return batched(partial(_highlights, config), SPANS, text)


def _ranges(config: ScanConfig, texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = zip(strings(texts), starts.to_pylist(), ends.to_pylist(), strict=True)
    return span_lists([in_range(t, a, b, config) if a is not None and b is not None else [] for t, a, b in rows])


def anonymize_range(df: DataFrame, start: Column, end: Column, mode: str, *, text_col: str = "text", config: ScanConfig = OFFLINE) -> DataFrame:
    """df with spans (those that touch the range) and hidden (the text with them replaced by hash or mask)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("spans", batched(partial(_ranges, config), SPANS, text, start.cast("int"), end.cast("int")))
    return out.withColumn("hidden", anonymize(text, F.col("spans"), mode))
