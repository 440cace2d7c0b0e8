"""Every query of the engine against its SQL, and those without SQL against what their texts were made to hold."""

from __future__ import annotations

import pytest

from redactory.plans import oracles
from redactory.plans.notes import TEMPLATES, notes
from redactory.plans.queries import QUERIES


def rows(frame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(oracles.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    assert len(ours) > 0 or name == "document_spans"


def test_notes_hold_what_they_were_made_to(spark, sf_dir):
    from redactory.operators.scan import detect, findings

    found = findings(detect(notes(spark, sf_dir)), "note_id").selectExpr(f"note_id % {len(TEMPLATES)} AS t", "rule_id", "note_id").groupBy("t", "note_id").agg({"rule_id": "collect_list"}).toPandas()
    expected: dict[int, list[str]] = {}
    for t, rule in oracles.EXPECTED_KINDS:
        expected.setdefault(t, []).append(rule)
    seen = set()
    for r in found.itertuples():
        got = sorted(x for x in r[3] if not (r.t == 3 and x in ("credit-card", "aadhaar-india")))
        assert got == sorted(expected.get(r.t, [])), (r.t, got)
        seen.add(r.t)
    assert seen >= set(expected)


@pytest.mark.parametrize("name", ["detect_documents"])
def test_queries_without_sql_return_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
