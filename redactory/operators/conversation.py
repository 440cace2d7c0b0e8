"""Credentials that a turn asks for and a later one gives."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.arrays import batched
from redactory.functions.lexicon import CARRY_TURNS
from redactory.operators.contextual import carried_over
from redactory.operators.redact import mint, pairs_of, redact, redact_known, typed
from redactory.operators.scan import ScanConfig, finish, parts
from redactory.operators.spans import SPANS, span_lists
from redactory.session import materialize


def expectations(seen: DataFrame, conversation: str = "conv_id", turn: str = "turn", turns: int = CARRY_TURNS) -> DataFrame:
    """seen with expected (rule_id, label): the last credential keyword of the latest of the `turns` turns before that has one.

    A turn's own keywords arm the turns after it only. The window holds `turns` rows of a conversation at a time.
    """
    last = F.try_element_at("keywords_seen", F.lit(-1))
    if turns <= 0:
        return seen.withColumn("expected", F.lit(None).cast("struct<rule_id:string,label:string>"))
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(-turns, -1)
    return seen.withColumn("expected", F.last(last, ignorenulls=True).over(before))


def _carried(texts: pa.Array, rules: pa.Array, labels: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), rules.to_pylist(), labels.to_pylist(), strict=True)
    return span_lists([carried_over(t, r, l) if t and r else [] for t, r, l in rows])


def detect_conversations(turns: DataFrame, config: ScanConfig | None = None, *, conversation: str = "conv_id", turn: str = "turn", text_col: str = "text", carry_turns: int = CARRY_TURNS) -> DataFrame:
    """detect() by line over the turns of conversations, with values carried over. One shuffle by conversation."""
    config = replace(config or ScanConfig(), by_line=True)
    found = parts(turns, text_col, config)
    if config.secrets:
        found = expectations(found, conversation, turn, carry_turns)
        more = batched(_carried, SPANS, F.col(text_col), F.col("expected.rule_id"), F.col("expected.label"))
        found = found.withColumn("__context", F.concat("__context", more))
    return finish(found, text_col, config)


def redact_history(turns: DataFrame, mappings: DataFrame | None, *, session: str = "conv_id", turn: str = "turn", text_col: str = "text", config: ScanConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns with redacted, all mappings): the turns of a session before its next prompt, made safe again.

    A session that has issued placeholders has its known values replaced, which needs no scan. Turns of any other session are scanned in
    full, in order, and its values numbered from one.
    """
    if mappings is None:
        cold, warm = turns, None
    else:
        known = mappings.select(session).distinct()
        cold, warm = turns.join(known, session, "left_anti"), turns.join(pairs_of(mappings, session), session)
    found = materialize(detect_conversations(cold, config, conversation=session, turn=turn, text_col=text_col), "history")
    new = materialize(mint(typed(found, session, turn), session, turn), "history-mappings")
    out = redact(found, new, session, [session, turn], text_col).select(*turns.columns, "redacted")
    if warm is None:
        return out, new
    replaced = warm.withColumn("redacted", redact_known(F.coalesce(F.col(text_col), F.lit("")), F.col("pairs"))).select(*turns.columns, "redacted")
    return out.unionByName(replaced), new.unionByName(mappings.select(new.columns))
