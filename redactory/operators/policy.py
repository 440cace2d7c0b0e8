"""What happens to a text: allow, redact or block, with the reason; and the record of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactory.functions.predicates import entity_type_column
from redactory.operators.spans import highest


def decide(spans: Column, business: Column, *, block_business: bool = True, block_high: bool = False) -> Column:
    """struct<action, reason>. The reasons are fixed values: the audit holds them word for word."""
    high = F.filter(spans, lambda s: s["severity"] == "high")
    out = F.when(F.size(spans) == 0, _decision("allow", F.lit("No sensitive content detected.")))
    if block_high:
        reason = F.concat(F.lit("Blocked: "), F.size(high).cast("string"), F.lit(" high-severity match(es) found (e.g. "), F.try_element_at(high, F.lit(1))["label"], F.lit(")."))
        out = out.when(highest(spans) == 2, _decision("block", reason))
    out = out.otherwise(_decision("redact", F.concat(F.lit("Redacted "), F.size(spans).cast("string"), F.lit(" match(es) before sending to the model."))))
    if block_business:
        tail = ". This looks like it may reference confidential business content — rephrase without specific figures, project names, or internal plans, or request an exception."
        out = F.when(F.size(business) > 0, _decision("block", F.concat(F.lit("Blocked: "), F.try_element_at(business, F.lit(1))["label"], F.lit(tail)))).otherwise(out)
    return out


def _decision(action: str, reason: Column) -> Column:
    return F.struct(F.lit(action).alias("action"), reason.alias("reason"))


def audit_details(spans: Column, tokens: Column | None = None, *, with_values: bool = False) -> Column:
    """array<struct<rule_id, label, severity, category, entity_type, token, value>>; values only if they are asked for."""
    token = tokens if tokens is not None else F.transform(spans, lambda _: F.lit(None).cast("string"))
    return F.zip_with(
        spans,
        token,
        lambda s, t: F.struct(
            s["rule_id"].alias("rule_id"), s["label"].alias("label"), s["severity"].alias("severity"), s["category"].alias("category"),
            entity_type_column(s["rule_id"], s["category"]).alias("entity_type"), t.alias("token"), (s["value"] if with_values else F.lit(None).cast("string")).alias("value"),
        ),
    )


def audit_entry(decision: Column, details: Column, source: str, at: Column | None = None) -> Column:
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.struct(stamp.alias("timestamp"), F.lit(source).alias("source"), decision["action"].alias("action"), decision["reason"].alias("reason"), details.alias("details"))
