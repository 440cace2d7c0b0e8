"""Functions for SQL: detect_spans(text), redact(text, mode), restore(text, pairs), and the table function scan_text(text)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from redactory.functions.arrays import arrow, strings
from redactory.functions.predicates import entity_type
from redactory.operators.redact import hidden_value, restore_text
from redactory.operators.scan import ScanConfig, scan_text
from redactory.operators.spans import SPANS, span_lists
from redactory.session import ship_package

ROW = "rule_id string, label string, severity string, category string, value string, start int, `end` int"
PAIRS = "array<struct<token:string,value:string>>"


def _detect(config: ScanConfig, texts: pa.Array) -> pa.Array:
    return span_lists([scan_text(t, config).spans(config) for t in strings(texts)])


def redacted(text: str, mode: str, config: ScanConfig) -> str:
    """A text with all that is found hidden (hash or mask)."""
    out, at = [], 0
    for s in scan_text(text, config).spans(config):
        out += [text[at : s[5]], hidden_value(s[4], entity_type(s[0], s[3]), mode)]
        at = s[6]
    return "".join([*out, text[at:]])


def _redact(config: ScanConfig, texts: pa.Array, modes: pa.Array) -> pa.Array:
    return pa.array([redacted(t, m, config) for t, m in zip(strings(texts), modes.to_pylist(), strict=True)], pa.string())


def _restore(texts: pa.Array, pairs: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), pairs.to_pylist(), strict=True)
    return pa.array([t if t is None else restore_text(t, [(p["token"], p["value"]) for p in own or []]) for t, own in rows], pa.string())


def scanner(config: ScanConfig) -> type:
    """The table function: a row for each span of a text."""

    class ScanText:
        def eval(self, text: str) -> Iterator[tuple]:
            yield from scan_text(text or "", config).spans(config)

    return ScanText


def register(spark: SparkSession, config: ScanConfig | None = None) -> None:
    """Makes the functions known to a session's SQL. config may bring rules of one's own (ScanConfig.rules)."""
    ship_package(spark)
    config = config or ScanConfig()
    spark.udf.register("detect_spans", arrow(partial(_detect, config), SPANS, 1))
    spark.udf.register("redact", arrow(partial(_redact, config), "string", 2))
    spark.udf.register("restore", arrow(_restore, "string", 2))
    spark.udtf.register("scan_text", F.udtf(scanner(config), returnType=ROW))
