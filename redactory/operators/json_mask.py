"""JSON documents: strings under sensitive names are replaced whole, other strings by what is found in them; nothing else changes.

Documents are taken apart into their strings (one Arrow stage), the strings are scanned and numbered like any table of texts, and the
documents are put together again by path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactory.functions.arrays import batched, lists
from redactory.functions.comments import language_of
from redactory.functions.lexicon import FIELD_NAMES
from redactory.operators.redact import hidden, mint, redact, restore_text, typed, with_pairs
from redactory.operators.scan import ScanConfig, detect
from redactory.operators.spans import SPANS, span
from redactory.session import materialize


def field_name(key: str) -> str:
    """A key in lower case without underscores, hyphens and spaces."""
    return re.sub(r"[_\-\s]", "", key.lower())


def field_name_column(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[_\-\s]", "")


def rewrite(node, change: Callable[[str, str | None], str]):
    """A copy of a JSON value with each string changed, given the key above it; items of arrays have the array's key. No recursion."""
    box = [None]
    todo = [(box, 0, node, None)]
    while todo:
        where, at, x, key = todo.pop()
        if isinstance(x, str):
            where[at] = change(x, key)
        elif isinstance(x, list):
            where[at] = own = [None] * len(x)
            todo += [(own, i, y, key) for i, y in reversed(list(enumerate(x)))]
        elif isinstance(x, dict):
            where[at] = own = dict.fromkeys(x)
            todo += [(own, k, y, k) for k, y in reversed(x.items())]
        else:
            where[at] = x
    return box[0]


def strings_of(document: str | None) -> list[tuple[str | None, str]]:
    """(key, text) of the strings of a document in order; none if it isn't JSON."""
    out: list[tuple[str | None, str]] = []
    try:
        rewrite(json.loads(document or "null"), lambda text, key: out.append((key, text)) or text)
    except ValueError:
        return []
    return out


def _leaves(documents: pa.Array) -> pa.Array:
    return lists([strings_of(x) for x in documents.to_pylist()], ("key", "text"), (pa.string(), pa.string()))


def _filled(documents: pa.Array, texts: pa.Array) -> pa.Array:
    """Documents with their strings replaced, in order; the text as it is where there are none."""
    out = []
    for document, own in zip(documents.to_pylist(), texts.to_pylist(), strict=True):
        left = iter(own or [])
        out.append(document if not own else json.dumps(rewrite(json.loads(document), lambda text, key: next(left)), ensure_ascii=False, separators=(",", ":")))  # noqa: B023
    return pa.array(out, pa.string())


def _restored(documents: pa.Array, pairs: pa.Array) -> pa.Array:
    out = []
    for document, own in zip(documents.to_pylist(), pairs.to_pylist(), strict=True):
        known = [(p["token"], p["value"]) for p in own or []]
        try:
            out.append(document and json.dumps(rewrite(json.loads(document), lambda text, key: restore_text(text, known)), ensure_ascii=False, separators=(",", ":")))  # noqa: B023
        except ValueError:
            out.append(document)
    return pa.array(out, pa.string())


def json_strings(documents: DataFrame, key: list[str], json_col: str) -> DataFrame:
    """A row for each string: the key columns, leaf (its number), field, text."""
    taken = documents.select(*key, batched(_leaves, "array<struct<key:string,text:string>>", F.col(json_col)).alias("leaves"))
    return taken.select(*key, F.posexplode("leaves").alias("leaf", "x")).select(*key, "leaf", F.col("x.key").alias("field"), F.col("x.text").alias("text"))


def by_field(detected: DataFrame) -> DataFrame:
    """detected strings, with one span over the whole text where the field's name is sensitive and the text isn't empty."""
    name = field_name_column(F.coalesce("field", F.lit("")))
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in FIELD_NAMES.items() for x in (k, v[i])))[name]
    whole = span(F.concat(F.lit("mcp-field-"), name), F.concat("field", F.lit(" field (MCP field-level match)")), pick(1), pick(0), F.col("text"), F.lit(0), F.length("text"))
    return detected.withColumn("spans", F.when(name.isin(list(FIELD_NAMES)) & (F.length("text") > 0), F.array(whole).cast(SPANS)).otherwise(F.col("spans")))


def redact_json(documents: DataFrame, session: str, key: list[str], json_col: str = "json", config: ScanConfig | None = None, issued: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with redacted, mappings of the sessions). key identifies a document and orders a session's documents."""
    keys = [session, *[k for k in key if k != session]]
    # strings are scanned once: numbering, the texts and their places all read what was found
    found = materialize(by_field(detect(json_strings(documents, keys, json_col), "text", config or ScanConfig(by_line=True))).select(*keys, "leaf", "text", "spans"), "json-strings")
    order = [k for k in key if k != session]
    mappings = materialize(mint(typed(found, session, *order, "leaf"), session, *order, "leaf", issued=issued), "json-mappings")
    hidden_ = found.where(F.size("spans") > 0)
    texts = redact(hidden_, mappings, session, [*keys, "leaf"]).select(*keys, "leaf", "redacted")
    every = found.where(F.size("spans") == 0).select(*keys, "leaf", F.col("text").alias("redacted")).unionByName(texts)
    own = every.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "redacted"))), lambda x: x["redacted"]).alias("__texts"))  # the strings of one document
    filled = batched(_filled, "string", F.col(json_col), F.col("__texts"))
    return documents.join(own, keys, "left").withColumn("redacted", filled).drop("__texts"), mappings


def restore_json(documents: DataFrame, json_col: str, pairs_col: str) -> Column:
    """A Column: the document with tokens restored in all its strings; pairs_col holds array<struct<token, value>>."""
    return batched(_restored, "string", F.col(json_col), F.col(pairs_col))


# --- columns whose schema is known


def mask_value(value: Column, kind: T.DataType, name: str | None, mode: str) -> Column:
    """A column with the strings under sensitive names hidden (hash or mask), by its schema: no Python at run time."""
    if isinstance(kind, T.StructType):
        fields = [mask_value(value[f.name], f.dataType, f.name, mode).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: mask_value(x, kind.elementType, name, mode))
    known = FIELD_NAMES.get(field_name(name)) if name else None
    if isinstance(kind, T.StringType) and known:
        from redactory.functions.predicates import entity_type

        return F.when(F.length(value) > 0, hidden(value, F.lit(entity_type(f"mcp-field-{field_name(name)}", known[0])), mode)).otherwise(value)
    return value


def mask_columns(df: DataFrame, mode: str = "hash") -> DataFrame:
    """All columns of a table with sensitive names, at any depth of structs and arrays, hidden."""
    return df.select(*(mask_value(F.col(f"`{f.name}`"), f.dataType, f.name, mode).alias(f.name) for f in df.schema.fields))


# --- tool calls


def tool_round_trip(calls: DataFrame, mappings: DataFrame, session: str, key: list[str], run: Callable[[DataFrame], DataFrame], *, json_col: str = "json", config: ScanConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls with result and redacted, all mappings): arguments get their values back, the tool runs, what it returns is made safe again.

    run: adds a column `result` (JSON text) to a table whose json_col holds the real arguments. Known values keep their placeholders.
    """
    pairs = with_pairs(calls, mappings, session, key, json_col)
    real = pairs.withColumn(json_col, restore_json(pairs, json_col, "pairs")).drop("pairs")
    done = materialize(run(real).select(*key, "result", *([session] if session not in key else [])), "tool-results")
    out, new = redact_json(done, session, key, "result", config, issued=mappings)
    keys = [session, *[k for k in key if k != session]]
    return calls.join(out.select(*keys, "redacted"), keys, "left"), new


#: How deep an argument may stand: a fixed value.
LANGUAGE_DEPTH = 4


def tool_language(document: str | None) -> str | None:
    """The language of the first text in a tool's arguments, in order, that is a language or the name of a file of one."""
    try:
        todo = [(json.loads(document or "null"), 0)]
    except ValueError:
        return None
    while todo:
        node, depth = todo.pop()
        if isinstance(node, str) and (found := language_of(node)):
            return found
        if depth < LANGUAGE_DEPTH and isinstance(node, dict | list):
            children = list(node.values() if isinstance(node, dict) else node)
            todo += [(x, depth + 1) for x in reversed(children)]
    return None


def _languages(documents: pa.Array) -> pa.Array:
    return pa.array([tool_language(x) for x in documents.to_pylist()], pa.string())


def tool_language_column(document: Column) -> Column:
    return batched(_languages, "string", document)
