"""Sessions as a stream: placeholders numbered as turns arrive, credentials expected from turn to turn.

Detection is stateless and runs before the state; the state of a session is its mappings, its counters and what credential is expected.
Within a trigger a session's rows are taken in order of their turn. Idle sessions are forgotten after a time, if one is given.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from redactory.functions.lexicon import CARRY_TURNS
from redactory.functions.predicates import entity_type
from redactory.operators.contextual import carried_over
from redactory.operators.scan import ScanConfig, parts
from redactory.operators.spans import FIELDS

OUT = "session string, turn long, redacted string, tokens array<string>"


def merged(structural: list[dict], context: list[dict]) -> list[dict]:
    """Disjoint spans, as redactory.operators.spans.merge has them."""
    ordered = sorted([(s["start"], 0, i, s) for i, s in enumerate(structural)] + [(s["start"], 1, i, s) for i, s in enumerate(context)], key=lambda x: x[:3])
    out: list[dict] = []
    for _, _, _, s in ordered:
        if not out or s["start"] >= out[-1]["end"]:
            out.append(s)
    return out


class SessionProcessor(StatefulProcessor):
    """One session: rows of (turn, text, structural, context, seen), the last three as JSON."""

    def __init__(self, carry_turns: int = CARRY_TURNS, idle_ms: int | None = None):
        self.carry_turns, self.idle_ms = carry_turns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "key string", "token string", ttlDurationMs=self.idle_ms)
        self.counters = handle.getMapState("counters", "entity_type string", "n long", ttlDurationMs=self.idle_ms)
        self.expected = handle.getValueState("expected", "rule_id string, label string, left int", ttlDurationMs=self.idle_ms)

    def token(self, entity: str, value: str) -> str:
        key = (json.dumps([entity, value]),)
        if self.tokens.containsKey(key):
            return self.tokens.getValue(key)[0]
        n = (self.counters.getValue((entity,))[0] if self.counters.containsKey((entity,)) else 0) + 1
        self.counters.updateValue((entity,), (n,))
        self.tokens.updateValue(key, (f"<<{entity}_{n}>>",))
        return f"<<{entity}_{n}>>"

    def turn(self, text: str, structural: list[dict], context: list[dict], seen: list[dict]) -> tuple[str, list[str]]:
        expected = self.expected.get() if self.expected.exists() else None
        if expected:
            context = context + [dict(zip(FIELDS, x, strict=True)) for x in carried_over(text, expected[0], expected[1])]
        if seen and self.carry_turns > 0:
            self.expected.update((seen[-1]["rule_id"], seen[-1]["label"], self.carry_turns))
        elif expected and expected[2] > 1:
            self.expected.update((expected[0], expected[1], expected[2] - 1))
        elif expected:
            self.expected.clear()
        out, at, tokens = [], 0, []
        for s in merged(structural, context):
            tokens.append(self.token(entity_type(s["rule_id"], s["category"]), s["value"]))
            out += [text[at : s["start"]], tokens[-1]]
            at = s["end"]
        return "".join([*out, text[at:]]), tokens

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("turn", kind="stable")
        done = [self.turn(r.text, json.loads(r.structural), json.loads(r.context), json.loads(r.seen)) for r in every.itertuples()]
        yield pd.DataFrame({"session": [key[0]] * len(every), "turn": every["turn"].to_list(), "redacted": [x for x, _ in done], "tokens": [t for _, t in done]})

    def close(self) -> None:
        pass


def redact_stream(turns: DataFrame, *, session: str = "session", turn: str = "turn", text_col: str = "text", config: ScanConfig | None = None, carry_turns: int = CARRY_TURNS, idle_ms: int | None = None) -> DataFrame:
    """A stream of (session, turn, redacted, tokens). The state store must be RocksDB."""
    found = parts(turns, text_col, config or ScanConfig(by_line=True))
    rows = found.select(F.col(session).cast("string").alias("session"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.to_json("__structural").alias("structural"), F.to_json("__context").alias("context"), F.to_json("keywords_seen").alias("seen"))
    return rows.groupBy("session").transformWithStateInPandas(SessionProcessor(carry_turns, idle_ms), OUT, "Append", "None" if idle_ms is None else "ProcessingTime")


def audit_batches(entries: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends audit entries batch by batch; a failed batch is logged by the sink and passed over."""
    from redactory.sources.files import append_audit

    return entries.writeStream.foreachBatch(lambda df, _: append_audit(df, path)).option("checkpointLocation", checkpoint).start()
