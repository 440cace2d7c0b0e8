"""Detectors that need words nearby: numbers, ids, host names, ports, person names, conversational credentials.

Functions over one text (a whole one or a line). They decide in order and claim tokens as they go, which no join over tokens expresses;
the scan runs them all in one Arrow stage. A text is read into tokens once per dialect, and words are only looked at around keywords.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column

from redactory.functions import lexicon as fixed
from redactory.functions.arrays import batched, strings
from redactory.functions.predicates import digits_of, is_account_name, is_secret_shaped, strip_quotes, trim_word, unquoted, within_edits
from redactory.functions.tokens import Token, plain_tokens, proximity_tokens
from redactory.operators.infra import is_internal
from redactory.operators.spans import SPANS, Found, span_lists

_HOST = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+){1,4}\Z")
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_FQDN = re.compile(rf"{_LABEL}(?:\.{_LABEL})+\Z")
_NAME = re.compile(r"[A-Z][a-z]+\Z")
_PLACEHOLDER = re.compile(r"<<\s*[A-Za-z][A-Za-z0-9_]*?_[0-9]+\s*>>")
_IDS = [(group, label, frozenset(words), re.compile(f"(?:{shape})\\Z")) for group, label, words, shape in fixed.ID_GROUPS]
_NUMBERS = [(group, label, severity, frozenset(words), low, high) for group, label, severity, words, low, high in fixed.NUMBER_GROUPS]
_AADHAAR, _HOSTS, _PORTS, _NOT_NAMES = map(frozenset, (fixed.AADHAAR_KEYWORDS, fixed.HOST_KEYWORDS, fixed.PORT_KEYWORDS, fixed.NOT_NAMES))


_PII_WORDS = frozenset().union(*(k for _, _, k, _ in _IDS), *(x[3] for x in _NUMBERS))
_INFRA_WORDS = _HOSTS | _PORTS
#: What every host name in full has, unless it ends on a reserved label.
_QUALIFIED = re.compile(r"[A-Za-z0-9]\.[A-Za-z0-9-]+\.[A-Za-z0-9]")


class Words:
    """Tokens of the plain dialect with their words in lower case."""

    def __init__(self, text: str):
        self.tokens: list[Token] = plain_tokens(text)
        self.words = [trim_word(t[0]).lower() for t in self.tokens]

    def around(self, i: int, reach: int) -> Iterator[int]:
        """Neighbours of a token from left to right, without itself."""
        return (j for j in range(max(0, i - reach), min(len(self.tokens), i + reach + 1)) if j != i)

    def near(self, i: int, keywords: frozenset[str], reach: int) -> bool:
        return any(self.words[j] in keywords for j in self.around(i, reach))


def national_ids(w: Words) -> list[Found]:
    """Bare 12-digit numbers with a keyword nearby. They are looked for in whole texts, across lines."""
    out = []
    for i, (raw, start, end) in enumerate(w.tokens):
        if len(raw) >= 12 and (digits := digits_of(raw)) and len(digits) == 12 and w.near(i, _AADHAAR, fixed.AADHAAR_WINDOW):
            out.append(("aadhaar-india-contextual", "Aadhaar (India National ID, contextual)", "high", "PII", digits, start, end))
    return out


def government_ids(w: Words) -> list[Found]:
    """The first token of an id's shape around each keyword; a token is taken once."""
    out, taken = [], set()
    for i, word in enumerate(w.words):
        for group, label, keywords, shape in _IDS:
            if word not in keywords:
                continue
            for j in w.around(i, fixed.NUMBER_WINDOW):
                value = trim_word(w.tokens[j][0])
                if j not in taken and shape.match(value.upper()):
                    taken.add(j)
                    start = w.tokens[j][1] + w.tokens[j][0].index(value)
                    out.append((f"contextual-{group}", label, "high", "PII", value, start, start + len(value)))
                    break
    return out


def numbers(w: Words) -> list[Found]:
    """All numbers of a group's length around its keywords, each once in a group. The value is the digits, the span the whole token."""
    out, taken = [], set()
    for i, word in enumerate(w.words):
        for group, label, severity, keywords, low, high in _NUMBERS:
            if word in keywords:
                for j in w.around(i, fixed.NUMBER_WINDOW):
                    raw, start, end = w.tokens[j]
                    if (group, j) not in taken and (digits := digits_of(raw)) and low <= len(digits) <= high:
                        taken.add((group, j))
                        out.append((f"contextual-{group}", label, severity, "PII", digits, start, end))
    return out


def person_names(w: Words) -> list[Found]:
    out = []
    for (a, start, _), (b, _, end) in zip(w.tokens, w.tokens[1:], strict=False):
        pair = trim_word(a), trim_word(b)
        if all(_NAME.match(x) and x not in _NOT_NAMES for x in pair):
            out.append(("heuristic-person-name", "Possible Person Name (heuristic, experimental)", "low", "PII", " ".join(pair), start, end))
    return out


def host_names(w: Words) -> list[Found]:
    """Qualified internal names anywhere, and hyphenated names with a digit near a word for machines."""
    out = []
    for i, (raw, start, _) in enumerate(w.tokens):
        value, at = unquoted(raw, start)
        low = value.lower()
        if _FQDN.match(value) and (low.endswith((".local", ".internal")) or low.count(".") >= 2) and is_internal(value):
            out.append(("internal-hostname", "Internal Hostname", "medium", "INFRA", value, at, at + len(value)))
            continue
        clean = trim_word(raw)
        if "-" in clean and _HOST.match(clean) and re.search("[0-9]", clean) and w.near(i, _HOSTS, fixed.HOST_WINDOW):
            # the place is counted from the token's own start
            out.append(("internal-hostname-contextual", "Internal Hostname (contextual)", "medium", "INFRA", clean, start, start + len(clean)))
    return out


def ports(w: Words) -> list[Found]:
    """The first number that can be a port around each mention of a port."""
    out = []
    for i, word in enumerate(w.words):
        if word in _PORTS:
            hit = next((j for j in w.around(i, fixed.PORT_WINDOW) if (d := digits_of(w.tokens[j][0])) and 1 <= int(d[-400:]) <= 65535 and len(d.lstrip("0")) <= 5), None)
            if hit is not None:
                raw, start, end = w.tokens[hit]
                out.append(("port-contextual", "Port Number (contextual)", "low", "INFRA", digits_of(raw), start, end))
    return out


# --- conversational credentials

_PHRASES = sorted(((p.split(), f"proximity-{p.replace(' ', '-')}", label, name) for p, label, name in fixed.PHRASES), key=lambda x: -len(x[0]))
_KEYWORDS = sorted({k for words, *_ in _PHRASES for k in words})


#: Letters of long keywords as bits: an edit changes at most two of them.
_LETTERS = [(k, 2 if len(k) >= fixed.FUZZY_LONG else 1, frozenset(k)) for k in _KEYWORDS if len(k) >= fixed.FUZZY_FLOOR]
_EXACT = frozenset(_KEYWORDS)
_RUN = re.compile("[a-z0-9_./@-]+")


def may_hold_credentials(text: str) -> bool:
    """Whether any run of a text stands for a keyword: if not, there is nothing to find."""
    return any(keywords_in(t) for t in set(_RUN.findall(text.lower())))


def keywords_in(token: str) -> frozenset[str]:
    """The keywords that a token (in lower case) stands for. Tokens of any length count; long ones, which hardly repeat, aren't remembered."""
    return _remembered(token) if len(token) <= 60 else _keywords_in(token)


def _keywords_in(token: str) -> frozenset[str]:
    """The keywords that a token (in lower case) stands for: itself, a part between underscores, its singular, or a long one misspelt."""
    own = strip_quotes(token)
    found = _EXACT.intersection((own, own.removesuffix("s"), *(own.split("_") if "_" in own else ())))
    if 7 <= len(own) <= 13:
        letters = set(own)
        near = [k for k, most, of in _LETTERS if abs(len(own) - len(k)) <= most and len(letters ^ of) <= 2 * most and within_edits(own, k, most)]
        found = found.union(near) if near else found
    return found


_remembered = lru_cache(maxsize=200_000)(_keywords_in)


def credentials(text: str) -> tuple[list[Found], list[tuple[str, str]]]:
    """Spans of values near keywords, and the keywords seen (rule id, label) in order, with or without a value.

    Longer phrases come first at each place, and a token is part of one phrase only. The value is the first that fits in the window.
    """
    tokens = proximity_tokens(text)
    stands_for = [keywords_in(t.lower()) for t, _, _ in tokens]
    found, seen, used = [], [], set()
    for i, here in enumerate(stands_for):
        if not here:
            continue
        for words, rule_id, label, wants_name in _PHRASES:
            own = range(i, i + len(words))
            if own.stop > len(tokens) or not used.isdisjoint(own) or not all(k in stands_for[j] for j, k in zip(own, words, strict=True)):
                continue
            used.update(own)
            seen.append((rule_id, label))
            reach = fixed.NAME_WINDOW if wants_name else fixed.PHRASE_WINDOW
            fits = is_account_name if wants_name else is_secret_shaped
            for j in range(own.stop if wants_name else max(0, i - reach), min(len(tokens), own.stop + reach)):
                if j in own:
                    continue
                value, start = unquoted(tokens[j][0], tokens[j][1])
                if fits(value):
                    found.append((rule_id, label, "medium", "SECRET", value, start, start + len(value)))
                    break
    return sorted(found, key=lambda x: x[5]), seen


def carried_over(text: str, rule_id: str, label: str) -> list[Found]:
    """Every secret-shaped token of a turn that answers an earlier keyword, placeholders excepted. The span keeps quotes, the value doesn't."""
    placeholders = [m.span() for m in _PLACEHOLDER.finditer(text)]
    label = re.sub(r"\s*\(conversational\)\s*\Z", "", label) + " (carried from previous turn)"
    return [(rule_id, label, "medium", "SECRET", strip_quotes(t), a, b) for t, a, b in proximity_tokens(text) if is_secret_shaped(t) and not any(a < y and b > x for x, y in placeholders)]


def contextual_spans(text: str, *, pii: bool = True, infra: bool = True, secrets: bool = True, names: bool = False) -> tuple[list[Found], list[tuple[str, str]]]:
    """Spans of the detectors that are on, detector by detector, and the credential keywords seen."""
    out: list[Found] = []
    seen: list[tuple[str, str]] = []
    low = text.lower()
    words = {trim_word(x) for x in set(low.replace('"', " ").replace("'", " ").split())} if pii or infra else set()
    pii_words = names or not words.isdisjoint(_PII_WORDS)
    infra_words = not words.isdisjoint(_INFRA_WORDS) or ".local" in low or ".internal" in low or _QUALIFIED.search(text) is not None
    w = Words(text) if (pii and pii_words) or (infra and infra_words) else None
    pii, infra = pii and pii_words, infra and infra_words
    if pii:
        out += government_ids(w) + numbers(w) + (person_names(w) if names else [])
    if infra:
        out += sorted(host_names(w) + ports(w), key=lambda x: x[5])
    if secrets and may_hold_credentials(text):
        own, seen = credentials(text)
        out += own
    return out, seen


_BY_WORDS = {"national_ids": national_ids, "government_ids": government_ids, "numbers": numbers, "person_names": person_names, "host_names": host_names, "ports": ports}


def _by_words(detector: str, texts: pa.Array) -> pa.Array:
    return span_lists([_BY_WORDS[detector](Words(t)) for t in strings(texts)])


def spans_by_words(detector: str, text: Column) -> Column:
    """Spans of one of the detectors that read words (national_ids, government_ids, numbers, person_names, host_names, ports)."""
    return batched(partial(_by_words, detector), SPANS, text)
