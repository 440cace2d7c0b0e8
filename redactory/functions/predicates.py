"""Tests of values, as Column expressions and as plain functions over one value.

The plain functions serve the Arrow-batched detectors; both forms of a test give the same answers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactory.functions.lexicon import CREDENTIAL_SYMBOLS, ENTITY_TYPES, SEVERITIES, TYPE_WORDS

# Quotes, and below the characters of credentials, account names and stops.
QUOTES = "\"'`"
SYMBOL_CLASS = "[" + re.escape(CREDENTIAL_SYMBOLS) + "]"
_SECRET = re.compile(r"(?=[A-Za-z0-9_-]+\Z)(?=.*[A-Za-z])(?=.*[0-9])|(?=[A-Za-z0-9+/]+={0,2}\Z)(?:.*\+|.*=\Z)|(?=.*[A-Za-z])(?=.*[0-9])(?=.*" + SYMBOL_CLASS + ")", re.S)
_BAD_IN_SECRET = re.compile(r"[\s\"'`]")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9._@-]*[A-Za-z0-9]\Z")
_TYPES = frozenset(TYPE_WORDS)
_LITERAL = re.compile("[0-9]|" + SYMBOL_CLASS)
_STOPS = ".,;:!?)]}"


def strip_quotes(s: str) -> str:
    """Without one layer of equal quotes around it; a value with a line break keeps them."""
    inside = len(s) >= 2 and s[0] == s[-1] and s[0] in QUOTES
    return s[1:-1] if inside and not re.search("[\n\r  ]", s[1:-1]) else s


def is_secret_shaped(raw: str) -> bool:
    """Long enough, without spaces or quotes, and generated (letters and digits), encoded (base64 with evidence) or chosen (with a symbol)."""
    v = strip_quotes(raw)
    return len(v) >= 8 and not _BAD_IN_SECRET.search(v) and _SECRET.match(v) is not None


def secret_shaped(value: Column) -> Column:
    """is_secret_shaped() of a column."""
    v = strip_quotes_column(value)
    mixed = v.rlike("[A-Za-z]") & v.rlike("[0-9]")
    generated = v.rlike(r"^[A-Za-z0-9_-]+\z") & mixed
    encoded = v.rlike(r"^[A-Za-z0-9+/]+={0,2}\z") & (v.contains("+") | v.endswith("="))
    return (F.length(v) >= 8) & ~v.rlike("[\\s\\x{A0}\"'`]") & (generated | encoded | (mixed & v.rlike(SYMBOL_CLASS)))


def strip_quotes_column(value: Column) -> Column:
    return F.when(value.rlike("^\"[^\\n\\r]*\"\\z|^'[^\\n\\r]*'\\z|^`[^\\n\\r]*`\\z") & (F.length(value) >= 2), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def is_account_name(raw: str) -> bool:
    """An identifier with a separator inside, none of whose parts is a type or placeholder word."""
    v = strip_quotes(raw)
    return 3 <= len(v) <= 64 and _NAME.match(v) is not None and re.search("[._@-]", v) is not None and _TYPES.isdisjoint(re.split("[._-]", v.lower()))


def account_name(value: Column) -> Column:
    v = strip_quotes_column(value)
    parts = F.split(F.lower(v), "[._-]")
    return F.length(v).between(3, 64) & v.rlike(r"^[A-Za-z][A-Za-z0-9._@-]*[A-Za-z0-9]\z") & v.rlike("[._@-]") & ~F.arrays_overlap(parts, F.array(*map(F.lit, TYPE_WORDS)))


def assigned_literal(value: Column, whole: Column) -> Column:
    """Quoted where it was assigned (the two quotes may differ), or with a digit or a symbol of credentials."""
    quoted = F.exists(F.array(*(F.lit(a + b) for a in QUOTES for b in QUOTES)), lambda q: F.contains(whole, F.concat(F.substring(q, 1, 1), value, F.substring(q, 2, 1))))
    return (F.length(value) > 0) & (quoted | value.rlike("[0-9]") | value.rlike(SYMBOL_CLASS))


def is_assigned_literal(value: str, whole: str) -> bool:
    """assigned_literal() of one value."""
    if value and _LITERAL.search(value):
        return True
    at = whole.find(value) if value else -1
    while at >= 0:
        if at and whole[at - 1] in QUOTES and whole[at + len(value) : at + len(value) + 1] in (*QUOTES,):
            return True
        at = whole.find(value, at + 1)
    return False


def unquoted(token: str, start: int) -> tuple[str, int]:
    """The value inside all layers of quotes, without stops at its end, and where it begins."""
    while len(inner := strip_quotes(token)) < len(token):
        token, start = inner, start + 1
    return token.rstrip(_STOPS), start


def trim_word(s: str) -> str:
    """Without punctuation at its ends. The two ends differ: an opening bracket is cut on the right only, a closing one on the left."""
    return s.lstrip(".,;:!?)]").rstrip(".,;:!?([")


def digits_of(s: str) -> str | None:
    """The digits of a word of digits, hyphens and dots, else None."""
    v = re.sub(r"[-.\s\xa0]", "", trim_word(s))
    return v if v.isascii() and v.isdigit() else None


def trim_word_column(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"^[.,;:!?)\]]+", ""), r"[.,;:!?(\[]+\z", "")


def digits_column(s: Column) -> Column:
    v = F.regexp_replace(trim_word_column(s), r"[-.\s\x{A0}]", "")
    return F.when(v.rlike(r"^[0-9]+\z"), v)


def rank_of(severity: Column) -> Column:
    """0 to 2."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def entity_type(rule_id: str, category: str) -> str:
    """The type of a rule's placeholders."""
    low = rule_id.lower()
    for name, marks in ENTITY_TYPES:
        if any(low == m[1:] if m[0] == "=" else m in low for m in marks.split()):
            return name
    return category


def entity_type_column(rule_id: Column, category: Column) -> Column:
    low, out = F.lower(rule_id), category
    for name, marks in reversed(ENTITY_TYPES):
        hit = None
        for m in marks.split():
            one = low == m[1:] if m[0] == "=" else F.contains(low, F.lit(m))
            hit = one if hit is None else hit | one
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def luhn_valid(value: str) -> bool:
    """The check digit of a number; separators are passed over."""
    total, double = 0, False
    for c in reversed(value):
        if c in " -":
            continue
        d = ord(c) - 48
        total += (2 * d - 9 * (d > 4)) if double else d
        double = not double
    return total % 10 == 0


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether a becomes b by at most `most` insertions, deletions, substitutions or swaps of neighbours (none edited twice)."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        up, row = rows[-1], [i]
        for j, y in enumerate(b, 1):
            cost = min(up[j] + 1, row[j - 1] + 1, up[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return False
        rows.append(row)
    return rows[-1][-1] <= most
