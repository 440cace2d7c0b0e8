"""Placeholders: numbering values in a session, writing them into texts and back.

Numbering is in the order of first appearance for each session and type. The order of a table is given by columns, never by partitions.
A session's values are ranked by their first place, which is aggregated before anything is ranked, so repeated values cost one row.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.arrays import batched, flat_of
from redactory.functions.columns import let
from redactory.functions.predicates import entity_type_column

SHAPE = r"<<\s*([A-Za-z][A-Za-z0-9_]*?)_([0-9]+)\s*>>"
_SHAPE = re.compile(SHAPE)


def typed(detected: DataFrame, session: str, *order: str) -> DataFrame:
    """A row for each span: session, the columns of order, place, the span's fields and its entity_type."""
    rows = detected.select(session, *order, F.posexplode("spans").alias("place", "s")).select(session, *order, "place", "s.*")
    return rows.withColumn("entity_type", entity_type_column(F.col("rule_id"), F.col("category")))


def mint(spans: DataFrame, session: str, *order: str, issued: DataFrame | None = None) -> DataFrame:
    """session, entity_type, value, token, rule_id, label, category, severity of the distinct values of a session.

    issued: mappings (session, token, entity_type, value, ...) of before; known values keep their tokens, new ones are numbered on.
    """
    first = F.struct(*order, "place")
    names = ["rule_id", "label", "category", "severity"]
    found = spans.groupBy(session, "entity_type", "value").agg(F.min(F.struct(first.alias("at"), *names)).alias("m")).select(session, "entity_type", "value", "m.*")
    after = F.lit(0)
    if issued is not None:
        known = issued.select(session, "entity_type", "value")
        top = issued.groupBy(session, "entity_type").agg(F.max(F.regexp_extract("token", r"_(\d+)>>$", 1).cast("long")).alias("top"))
        found = found.join(known, [session, "entity_type", "value"], "left_anti").join(top, [session, "entity_type"], "left")
        after = F.coalesce("top", F.lit(0))
    number = F.row_number().over(Window.partitionBy(session, "entity_type").orderBy("at", "value")) + after
    new = found.withColumn("token", F.concat(F.lit("<<"), "entity_type", F.lit("_"), number.cast("string"), F.lit(">>"))).select(session, "entity_type", "value", "token", *names)
    return new if issued is None else new.unionByName(issued.select(new.columns))


def cut_in(text: Column, spans: Column, put: Column) -> Column:
    """A text with put[i] in place of spans[i]. Spans are in order; one that overlaps the one before is passed over."""
    return batched(_cut_in, "string", F.coalesce(text, F.lit("")), spans, put)


def _cut_in(texts: pa.Array, spans: pa.Array, put: pa.Array) -> pa.Array:
    flat, at = flat_of(spans)
    start, end = (flat.field(n).to_pylist() for n in ("start", "end"))
    values, value_at = flat_of(put)
    values, out = values.to_pylist(), []
    for row, text in enumerate(texts.to_pylist()):
        parts, done = [], 0
        for i, j in zip(range(at[row], at[row + 1]), range(value_at[row], value_at[row + 1]), strict=False):
            if start[i] >= done:
                parts += [text[done : start[i]], values[j] or ""]
                done = end[i]
        out.append("".join([*parts, text[done:]]))
    return pa.array(out, pa.string())


def redact(detected: DataFrame, mappings: DataFrame, session: str, key: list[str], text_col: str = "text") -> DataFrame:
    """detected with redacted: spans replaced by the session's tokens. key: what identifies a row.

    The spans meet their tokens by (session, type, value), which spreads a large session over its values.
    """
    rows = typed(detected, session, *[k for k in key if k != session])
    met = rows.join(mappings.select(session, "entity_type", "value", "token"), [session, "entity_type", "value"])
    own = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("__tokens"))  # the spans of one text
    tokens = F.transform(F.coalesce("__tokens", F.array().cast("array<struct<place:int,token:string>>")), lambda t: t["token"])
    return detected.join(own, key, "left").withColumn("redacted", cut_in(F.coalesce(F.col(text_col), F.lit("")), F.col("spans"), tokens)).drop("__tokens")


def hidden(value: Column, entity: Column, mode: str) -> Column:
    """A value by its hash ([TYPE_ and eight hex digits]) or by a mask; neither needs mappings."""
    if mode == "hash":
        return F.concat(F.lit("["), entity, F.lit("_"), F.substring(F.sha2(value, 256), 1, 8), F.lit("]"))
    if mode == "mask":
        return F.lit("***")
    raise ValueError(f"unknown mode {mode}")


def hidden_value(value: str, entity: str, mode: str) -> str:
    """hidden() of one value."""
    if mode == "hash":
        return f"[{entity}_{sha256(value.encode()).hexdigest()[:8]}]"
    if mode == "mask":
        return "***"
    raise ValueError(f"unknown mode {mode}")


def anonymize(text: Column, spans: Column, mode: str) -> Column:
    return cut_in(text, spans, F.transform(spans, lambda s: hidden(s["value"], entity_type_column(s["rule_id"], s["category"]), mode)))


# --- known values and restoring: pairs is array<struct<token, value>>, the mappings of a row's session


def pairs_of(mappings: DataFrame, session: str) -> DataFrame:
    """session, pairs in order of number. One row for a session: what a session has issued is small beside its texts."""
    number = F.regexp_extract("token", r"_(\d+)>>$", 1).cast("long")
    rows = mappings.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("entity_type", number.alias("n"), "token", "value"))).alias("p"))
    return rows.select(session, F.transform("p", lambda x: F.struct(x["token"].alias("token"), x["value"].alias("value"))).alias("pairs"))


def redact_known(text: Column, pairs: Column) -> Column:
    """Known values replaced by their tokens wherever they stand, longer values first."""
    usable = F.transform(F.filter(pairs, lambda p: F.length(p["value"]) > 0), lambda p, i: F.struct((-F.length(p["value"])).alias("n"), i.alias("i"), p["token"].alias("token"), p["value"].alias("value")))
    return F.aggregate(F.array_sort(usable), text, lambda acc, p: F.replace(acc, p["value"], p["token"]))


def restore_exact(text: Column, pairs: Column) -> Column:
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["token"], p["value"]))


def restore(text: Column, pairs: Column) -> Column:
    """Tokens replaced by their values: exact ones first, then those in another case or with spaces inside; unknown ones stay."""
    key = lambda s: F.upper(F.regexp_replace(s, r"[<>\s]", ""))
    known = F.transform(pairs, lambda p: F.struct(key(p["token"]).alias("key"), p["value"].alias("value")))

    def filled(exact: Column, found: Column, known: Column) -> Column:
        value = lambda s: let(key(s), lambda k: F.try_element_at(F.filter(known, lambda p: p["key"] == k), F.lit(-1))["value"])
        # what stands between the tokens, then the tokens or their values in between
        parts = F.zip_with(F.split(exact, SHAPE), found, lambda b, s: F.concat(b, F.when(s.isNull(), "").otherwise(F.coalesce(value(s), s))))
        return F.when(F.size(found) == 0, exact).otherwise(F.array_join(parts, ""))

    tokens = lambda exact: F.regexp_extract_all(exact, F.lit(SHAPE), F.lit(0))
    return let(restore_exact(text, pairs), lambda exact: let(tokens(exact), lambda found: let(known, lambda k: filled(exact, found, k))))


def with_pairs(df: DataFrame, mappings: DataFrame, session: str, key: list[str], text_col: str = "text") -> DataFrame:
    """df with pairs: the mappings, in order of number, of the tokens that each row's text holds. key identifies a row in its session.

    Tokens meet their mappings by (session, token): no row ever has all that a session issued.
    """
    canon = lambda s: F.upper(F.regexp_replace(s, r"[<>\s]", ""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [session, *[k for k in key if k != session]]
    held = df.select(*keys, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SHAPE), F.lit(0)), canon))).alias("__token"))
    number = F.regexp_extract("token", r"_(\d+)>>$", 1).cast("long")
    known = mappings.select(session, canon(F.col("token")).alias("__token"), F.struct("entity_type", number.alias("n"), "token", "value").alias("__pair"))
    met = held.join(known, [session, "__token"]).groupBy(*keys).agg(F.array_sort(F.collect_list("__pair")).alias("__pairs"))  # the tokens of one text
    pairs = F.transform(F.coalesce("__pairs", F.array().cast("array<struct<entity_type:string,n:bigint,token:string,value:string>>")), lambda x: F.struct(x["token"].alias("token"), x["value"].alias("value")))
    return df.join(met, keys, "left").withColumn("pairs", pairs).drop("__pairs")


def restore_rows(df: DataFrame, mappings: DataFrame, session: str, key: list[str], text_col: str = "text") -> DataFrame:
    """df with restored: restore() by the mappings of each row's session, of which a row gets those of its own tokens."""
    met = with_pairs(df, mappings, session, key, text_col)
    return met.withColumn("restored", restore(F.coalesce(F.col(text_col), F.lit("")), F.col("pairs"))).drop("pairs")


def issued_types(mappings: DataFrame, session: str) -> DataFrame:
    """session, types: the types of placeholders that a session issued, as unrestored() takes them. There are some dozens of types."""
    return mappings.groupBy(session).agg(F.sort_array(F.collect_set("entity_type")).alias("types"))


def unrestored(text: Column, issued_types: Column | None = None) -> Column:
    """Distinct tokens that are left in a text, of the types that were issued if these are given."""
    left = F.array_distinct(F.regexp_extract_all(text, F.lit(SHAPE), F.lit(0)))
    if issued_types is None:
        return left
    return F.filter(left, lambda s: F.array_contains(issued_types, F.upper(F.regexp_extract(s, SHAPE, 1))))


def restore_text(text: str, pairs: list[tuple[str, str]]) -> str:
    """restore() of one text."""
    for token, value in pairs:
        text = text.replace(token, value)
    known = {f"{m[1].upper()}_{m[2]}": value for token, value in pairs if (m := _SHAPE.search(token))}
    return _SHAPE.sub(lambda m: known.get(f"{m[1].upper()}_{m[2]}", m[0]), text)
