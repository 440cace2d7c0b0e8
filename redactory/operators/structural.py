"""Rules that are a pattern: credentials, personal and financial identifiers.

Patterns use ASCII word boundaries and white space, spelled out. A text is passed over once for each rule that may match: a rule runs only
on texts that hold one of its marks, a cheap test that every match implies. Places come with the matches, so nothing is counted again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from redactory.functions.arrays import batched, strings
from redactory.functions.predicates import is_account_name, is_assigned_literal, luhn_valid
from redactory.operators.spans import SPANS, Found, span_lists

L, R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# White space of the rules, which `\\s` stands for in their patterns.
SPACE = r"\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def compiled(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern with ASCII classes, but for white space."""
    out, inside = [], False
    for x in re.findall(r"\\.|.", pattern, re.S):
        inside = x == "[" or inside and x != "]"
        out.append((SPACE if inside else f"[{SPACE}]") if x == r"\s" else x)
    return re.compile("".join(out), flags | re.ASCII)


@dataclass(frozen=True)
class Rule:
    """before, value and after are patterns without capturing groups; the value alone is the span. marks: any of them is in every match."""

    rule_id: str
    label: str
    severity: str
    category: str
    value: str
    before: str = ""
    after: str = ""
    keep: Callable[[str, str], bool] | None = None  # of (value, whole match)
    marks: tuple[str, ...] = ()
    fold: bool = False  # without regard to case
    prefilter: str = ""
    places: Callable[[str], Iterator[tuple[int, int]]] | None = None  # finds what the pattern finds, in less time

    @cached_property
    def search(self) -> re.Pattern:
        return compiled(f"{self.before}({self.value}){self.after}", re.IGNORECASE if self.fold else 0)

    @cached_property
    def test(self) -> re.Pattern | None:
        return compiled(self.prefilter) if self.prefilter else None


_WORD_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_LOCAL_CHARS = _WORD_CHARS | frozenset(".%+-")
_DOMAIN = re.compile(rf"@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{R}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of the email rule, found from their at signs: a long run of its characters isn't tried from each of its places."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        while 0 < start < at and text[start - 1] in _WORD_CHARS:  # behind a match, in the middle of a word
            start += 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _luhn(value: str, whole: str) -> bool:
    return luhn_valid(value)


def _account(value: str, whole: str) -> bool:
    return is_account_name(value)


_Q = "[\"'`]?"
_ASSIGN = rf"{_Q}[ \t]*[:=][ \t]*['\"`]?"

# The rules' ids, labels, severities, categories and patterns.
SECRET_RULES = (
    Rule("aws-access-key", "AWS Access Key ID", "high", "SECRET", "AKIA[0-9A-Z]{16}", L, R, marks=("AKIA",)),
    Rule("aws-secret-key", "AWS Secret Access Key (assignment)", "high", "SECRET", "[A-Za-z0-9/+=]{40}", rf"{L}(?:aws_secret_access_key|secret_access_key)[ \t]*[:=][ \t]*['\"`]?", "['\"`]?", marks=("secret_access_key",), fold=True),
    Rule("private-key-block", "PEM Private Key Block", "high", "SECRET", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----(?s:.+?)-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", marks=("-----BEGIN ",)),
    Rule("generic-api-key", "Generic API Key Assignment", "high", "SECRET", "[A-Za-z0-9_-]{16,}+", rf"{_Q}{L}(?:api[_-]?key|apikey|access[_-]?token|auth[_-]?token|refresh[_-]?token|secret[_-]?key|client[_-]?secret|access[_-]?key){R}{_ASSIGN}", "['\"`]?", marks=("key", "token", "secret"), fold=True),
    Rule("openai-api-key", "OpenAI API Key", "high", "SECRET", "sk-(?:proj-|svcacct-|admin-)?[A-Za-z0-9_-]{20,}" + "(?<=[A-Za-z0-9_])", L, R, marks=("sk-",)),
    Rule("stripe-api-key", "Stripe API Key", "high", "SECRET", "(?:pk|sk|rk)_(?:test|live)_[A-Za-z0-9]{10,}", L, R, marks=("_test_", "_live_")),
    Rule("jwt", "JSON Web Token", "medium", "SECRET", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?<=[A-Za-z0-9_])", L, R, marks=("eyJ",)),
    Rule("slack-token", "Slack Token", "high", "SECRET", "xox[baprs]-[A-Za-z0-9-]{10,}(?<=[A-Za-z0-9])", L, R, marks=("xox",)),
    Rule("github-token", "GitHub Token", "high", "SECRET", "gh[pousr]_[A-Za-z0-9]{36,}", L, R, marks=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("generic-password-assignment", "Password Assignment", "medium", "SECRET", r"[^\s'\"`;,}()\[\]{]{6,}+", rf"{_Q}{L}(?:password|passwd|pwd){R}{_ASSIGN}", "['\"`]?", is_assigned_literal, marks=("passw", "pwd"), fold=True),
    Rule("username-assignment", "Username Assignment", "medium", "PII", "[A-Za-z][A-Za-z0-9._@-]{1,62}[A-Za-z0-9]", rf"{_Q}{L}(?:user[_-]?name|user[_-]?id|login|account[_-]?name){R}{_ASSIGN}", "['\"`]?", _account, marks=("user", "login", "account"), fold=True),
    Rule("env-var-secret", "Environment Variable Secret Assignment", "high", "SECRET", r"[^\s\"'`()\[\]{}]{8,}+", rf"{L}(?:export[ \t]+)?[A-Z][A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|CRED|KEY|AUTH)[A-Z0-9_]*[ \t]*=[ \t]*[\"'`]?", "[\"'`]?", is_assigned_literal, marks=("SECRET", "TOKEN", "PASSWORD", "PASSWD", "CRED", "KEY", "AUTH")),
    Rule("db-connection-string", "Database Connection String with Credentials", "high", "SECRET", r"(?:postgres|postgresql|mysql|mongodb(?:\+srv)?)://[^\s:]+:[^\s@]+@[^\s\"'`;,]+", L, marks=("://",), fold=True, prefilter="(?i)(?:postgres|postgresql|mysql|mongodb|srv)://"),
    Rule("sqlserver-connection-string", "SQL Server Connection String with Credentials", "high", "SECRET", rf"(?:Server|Data\s+Source)\s*=[^;\n]*;[^\n]*?{L}(?:Password|Pwd)\s*=[^;\n]*;?", L, marks=("server", "data"), fold=True, prefilter=r"(?i)(?:password|pwd)\s*="),
)

# Fixed values, as above.
PII_RULES = (
    Rule("email", "Email Address", "low", "PII", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", L, R, marks=("@",), places=_emails),
    Rule("pan-india", "PAN (India Tax ID)", "high", "PII", "[A-Z]{5}[0-9]{4}[A-Z]", L, R, prefilter="[A-Z][0-9]{4}[A-Z]"),
    Rule("ifsc-india", "IFSC (India Bank Branch Code)", "medium", "PII", "[A-Z]{4}0[A-Z0-9]{6}", L, R, prefilter="[A-Z]{4}0"),
    Rule("ssn-us", "SSN (US Social Security Number)", "high", "PII", "[0-9]{3}-[0-9]{2}-[0-9]{4}", L, R, prefilter="[0-9]-[0-9]{2}-[0-9]"),
    Rule("credit-card", "Credit/Debit Card Number", "high", "PII", "[0-9](?:[ -]?[0-9]){12,18}", L, R, _luhn, prefilter="[0-9][0-9 -]{11}[0-9]"),
    Rule("amount-inr", "Currency Amount (INR)", "medium", "PII", r"(?:₹|(?:Rs\.?|INR)\s?)\s?(?:[0-9]{1,2}(?:,[0-9]{2,3})+|[0-9]+)(?:\.[0-9]{1,2})?(?:\s?[kKmMbB])?", "", R, marks=("₹", "Rs", "INR")),
    Rule("amount-usd", "Currency Amount (USD)", "medium", "PII", r"\$\s?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]{1,2})?(?:\s?[kKmMbB])?", "", R, prefilter=r"\$\s?[0-9]"),
    Rule("aadhaar-india", "Aadhaar (India National ID)", "high", "PII", r"[0-9]{4}\s[0-9]{4}\s[0-9]{4}", L, R, prefilter=r"[0-9]{4}\s[0-9]{4}\s[0-9]{4}"),
)
RULES = {r.rule_id: r for r in (*SECRET_RULES, *PII_RULES)}


def matches(rule: Rule, text: str) -> Iterator[Found]:
    """Spans of one rule, in order. A match whose value is not kept still takes its text."""
    own = rule.rule_id, rule.label, rule.severity, rule.category
    if rule.places is not None:
        for start, end in rule.places(text):
            yield (*own, text[start:end], start, end)
        return
    for m in rule.search.finditer(text):
        value = m[1]
        if rule.keep is None or rule.keep(value, m[0]):
            yield (*own, value, m.start(1), m.end(1))


def spans_in(text: str, rules: tuple[Rule, ...] | None = None) -> list[Found]:
    """Spans of rules (all by default) in one text, rule by rule."""
    low, out = text.lower(), []
    for rule in ALL_RULES if rules is None else rules:
        if rule.marks:
            where = low if rule.fold else text
            for m in rule.marks:
                if m in where:
                    break
            else:
                continue
        if rule.test is None or rule.test.search(text):
            out += matches(rule, text)
    return out


def _spans(rules: tuple[Rule, ...], texts: pa.Array) -> pa.Array:
    return span_lists([spans_in(t, rules) for t in strings(texts)])


ALL_RULES = (*SECRET_RULES, *PII_RULES)


def structural_spans(text: Column, rules: tuple[Rule, ...] = ALL_RULES) -> Column:
    """Spans of all rules, rule by rule, in one pass of Arrow batches."""
    return batched(partial(_spans, tuple(rules)), SPANS, F.coalesce(text, F.lit("")))


def find(rule: Rule, text: Column) -> Column:
    """Spans of one rule, in order."""
    return structural_spans(text, (rule,))
