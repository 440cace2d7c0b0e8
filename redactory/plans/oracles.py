"""The same queries in ANSI SQL, written for DuckDB: its regular expressions have ASCII boundaries and no lookaround."""

from __future__ import annotations

import re

from redactory.functions import lexicon as fixed
from redactory.operators.embedding import load_data
from redactory.operators.structural import L, RULES, R, Rule
from redactory.plans import queries as q
from redactory.plans.notes import SQL as NOTES
from redactory.plans.notes import C, N, d, phrase_rows, s as text_of


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain(pattern: str) -> str:
    """A rule's pattern without lookaround and possessive repeats."""
    out = pattern.replace(L, r"\b").replace(R, r"\b")
    out = re.sub(r"\(\?<=\[A-Za-z0-9_?\]\)", "", out).replace("(?s:.+?)", r"[\s\S]+?")
    return re.sub(r"(\{\d+,\d*\})\+", r"\1", out)


def places(rule: Rule, source: str, key: str) -> str:
    """key, v (value), whole, start_at, end_at of a rule's matches, before values are tested."""
    flags = "(?is)" if rule.fold else "(?s)"
    pattern = lit(f"{flags}(.*?)({plain(rule.before)})({plain(rule.value)})({plain(rule.after)})")
    return f"""
SELECT {key}, v, b || v || e AS whole, CAST(coalesce(sum(length(a) + length(b) + length(v) + length(e)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(a) + length(b) AS BIGINT) AS start_at
FROM (
  SELECT {key}, unnest(range(len(v))) AS i, unnest(a) AS a, unnest(b) AS b, unnest(v) AS v, unnest(e) AS e
  FROM (SELECT {key}, regexp_extract_all(text, {pattern}, 1) AS a, regexp_extract_all(text, {pattern}, 2) AS b, regexp_extract_all(text, {pattern}, 3) AS v, regexp_extract_all(text, {pattern}, 4) AS e FROM ({source}))
)"""


LUHN = "list_sum(list_transform(range(length(n)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(n[length(n) - i] AS INT) ELSE (2 * CAST(n[length(n) - i] AS INT)) // 10 + (2 * CAST(n[length(n) - i] AS INT)) % 10 END)) % 10 = 0"
_TYPES = "[" + ", ".join(map(lit, fixed.TYPE_WORDS)) + "]"
_LITERAL = "(regexp_matches(v, '[0-9@#$%^&*!?~]') OR contains(whole, '\"' || v || '\"') OR contains(whole, '''' || v || '''') OR contains(whole, '`' || v || '`'))"
KEEP = {
    "generic-password-assignment": _LITERAL,
    "env-var-secret": _LITERAL,
    "username-assignment": f"regexp_matches(v, '[._@-]') AND len(list_intersect(string_split_regex(lower(v), '[._-]'), {_TYPES})) = 0",
    "credit-card": LUHN.replace("length(n)", "length(regexp_replace(v, '[ -]', '', 'g'))").replace("n[", "regexp_replace(v, '[ -]', '', 'g')["),
}


def structural(rule: Rule, source: str = NOTES, key: str = "note_id") -> str:
    return f"SELECT {key}, start_at, start_at + length(v) AS end_at, v AS value FROM ({places(rule, source, key)}) WHERE {KEEP.get(rule.rule_id, 'true')}"


def token_rows(pattern: str, source: str = NOTES) -> str:
    """note_id, i, token, start_at of tokens by a pattern without lookaround (no quote in these texts is escaped)."""
    p = lit(f"(?s)(.*?)({pattern})")
    return f"""
SELECT note_id, i, token, CAST(coalesce(sum(length(a) + length(token)) OVER (PARTITION BY note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(a) AS BIGINT) AS start_at
FROM (SELECT note_id, unnest(range(len(t))) AS i, unnest(a) AS a, unnest(t) AS token FROM (SELECT note_id, regexp_extract_all(text, {p}, 1) AS a, regexp_extract_all(text, {p}, 2) AS t FROM ({source})))"""


PLAIN_SQL = r"""
"[^"]*"|'[^']*'|[^\s"']+""".strip()
PROXIMITY_SQL = r"""
"[^"\s]*"|'[^'\s]*'|`[^`\s]*`|[A-Za-z0-9_./@-]+""".strip()
_TRIM = r"regexp_replace(regexp_replace(token, '^[.,;:!?)\]]+', ''), '[.,;:!?(\[]+$', '')"
WORDS = rf"SELECT *, lower(trimmed) AS word, CASE WHEN regexp_matches(regexp_replace(trimmed, '[-.\s]', '', 'g'), '^[0-9]+$') THEN regexp_replace(trimmed, '[-.\s]', '', 'g') END AS digits FROM (SELECT *, {_TRIM} AS trimmed FROM ({token_rows(PLAIN_SQL)}))"
_KEYWORDS = ", ".join(f"({lit(k)}, {lit(g)}, {low}, {high})" for g, _, _, ks, low, high in fixed.NUMBER_GROUPS for k in ks)

_SPANS3 = " UNION ALL ".join(f"SELECT note_id, session_id, {lit(t)} AS entity_type, v AS value, start_at FROM ({places(RULES[r], NOTES, 'note_id, session_id')})" for r, t in (("email", "EMAIL"), ("pan-india", "PAN"), ("jwt", "JWT")))
MINT = f"""
SELECT session_id, entity_type, value, '<<' || entity_type || '_' || CAST(row_number() OVER (PARTITION BY session_id, entity_type ORDER BY note_id, start_at) AS VARCHAR) || '>>' AS token
FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entity_type, value ORDER BY note_id, start_at) AS first FROM ({_SPANS3})) WHERE first = 1"""

_GRAMS = """
words AS (SELECT k, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM texts),
grams AS (SELECT k, w AS g FROM words UNION ALL SELECT k, '#' || w[i:i + 2] FROM (SELECT k, w, unnest(range(1, length(w) - 1)) AS i FROM words WHERE length(w) >= 4)),
distinct_grams AS (SELECT DISTINCT g FROM grams),
hashed AS (SELECT g, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(g) + 1), lambda i: CAST(ord(g[i]) AS BIGINT))), lambda h, c: CAST((xor(h, c)::HUGEINT * 16777619) % 4294967296 AS BIGINT)) AS h FROM distinct_grams),
buckets AS (SELECT g, least(h, 4294967296 - h) % 256 AS bucket FROM hashed),
counted AS (SELECT k, bucket, CAST(count(*) AS DOUBLE) AS n FROM grams JOIN buckets USING (g) GROUP BY ALL),
vectors AS (SELECT k, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS x FROM counted)"""


def _examples() -> str:
    rows = [(c, i, e) for c, es in (load_data("category_examples.json") or {}).items() for i, e in enumerate(es)]
    return ", ".join(f"({lit(c)}, {i}, {lit(e)})" for c, i, e in rows)


_CENTROIDS = f"""
examples(category, i, e) AS (VALUES {_examples()}),
sizes AS (SELECT category, count(*) AS m FROM examples GROUP BY 1)"""
_MEANS = """
means AS (SELECT split_part(k, '|', 1) AS category, bucket, sum(x) / any_value(m) AS x FROM vectors JOIN sizes ON sizes.category = split_part(k, '|', 1) GROUP BY ALL),
centroids AS (SELECT category, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY category)) AS x FROM means)"""

_ANSWER_RESTORED = "replace(replace('see server and the server at on or <<EMAIL_' || CAST(note_id % 3 AS VARCHAR) || '>> and <<EMAIL_' || CAST(note_id % 3 AS VARCHAR) || '>>', '<<EMAIL_1>>', 'user7@example.com'), '', '')"
_TURNS = "SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'password' WHEN 2 THEN 'access-token' END AS asked, (conv_id + turn) % 5 = 1 AS answers FROM conversations"

_SETTINGS_ROWS = ", ".join(f"({lit(k)}, {lit(r)}, {lit(f)}, {'true' if bad else 'false'})" for (k, r), bad, f in zip(q._SETTINGS, (True, False, True, False, True, False, False, True, False, True), ("0.15", "0.3", "128", "12", "true", "false", '["a*", "b"]', "[]", '"http://x"', '"http://localhost:9000"'), strict=True))


def _detected() -> list[tuple[int, str]]:
    """What the notes hold by the way that they were made: template, rule."""
    expected = {
        0: "pan-india", 1: "aadhaar-india-contextual", 4: "port-contextual", 5: "internal-hostname-contextual", 6: "proximity-password", 7: "internal-url external-url", 8: "unix-file-path unix-file-path",
        9: "private-ip-standalone mac-address", 10: "generic-password-assignment", 11: "generic-api-key", 12: "username-assignment", 13: "env-var-secret", 14: "db-connection-string", 15: "sqlserver-connection-string",
        16: "aws-access-key slack-token github-token", 17: "jwt amount-usd amount-inr", 18: "ifsc-india ssn-us", 19: "email contextual-phone", 20: "aws-secret-key", 21: "openai-api-key stripe-api-key", 22: "private-key-block",
        23: "contextual-passport-us", 24: "contextual-account-number contextual-customer-id", 26: "proximity-password", 27: "ipv6-link-local private-ip-standalone public-ip-standalone", 28: "aadhaar-india", 29: "windows-file-path",
    }
    return [(i, r) for i, rs in expected.items() for r in rs.split()]


ORACLES: dict[str, str] = {f"structural_{r.replace('-', '_')}": structural(rule) for r, rule in RULES.items()} | {
    "document_spans": " UNION ALL ".join(f"SELECT doc_id, {lit(r)} AS rule_id, start_at, v AS value FROM ({places(RULES[r], 'SELECT doc_id, text FROM documents', 'doc_id')}) WHERE {KEEP.get(r, 'true')}" for r in ("email", "credit-card")),
    "line_split": rf"""
SELECT note_id, CAST(start_at AS BIGINT) AS start_at, CASE WHEN i < n THEN regexp_replace(line, '\r$', '') ELSE line END AS line
FROM (SELECT note_id, i, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
  FROM (SELECT note_id, unnest(range(1, len(l) + 1)) AS i, len(l) AS n, unnest(l) AS line FROM (SELECT note_id, string_split(text, chr(10)) AS l FROM ({NOTES}))))
WHERE regexp_matches(line, '\S')""",
    "plain_tokens": token_rows(PLAIN_SQL),
    "proximity_tokens": token_rows(PROXIMITY_SQL),
    "number_context": f"""
WITH w AS ({WORDS}), k(word, kind, low, high) AS (VALUES {_KEYWORDS})
SELECT DISTINCT n.note_id, 'contextual-' || kind AS rule_id, n.start_at, n.digits FROM w AS a JOIN k USING (word) JOIN w AS n ON a.note_id = n.note_id AND abs(a.i - n.i) BETWEEN 1 AND 4 AND length(n.digits) BETWEEN low AND high""",
    "port_context": f"""
WITH w AS ({WORDS})
SELECT note_id, start_at, digits AS port FROM (SELECT a.note_id, n.start_at, n.digits, row_number() OVER (PARTITION BY a.note_id, a.i ORDER BY n.i) AS r FROM w AS a JOIN w AS n ON a.note_id = n.note_id AND abs(a.i - n.i) BETWEEN 1 AND 3
  WHERE a.word = 'port' AND try_cast(n.digits AS BIGINT) BETWEEN 1 AND 65535) WHERE r = 1""",
    "person_names": f"""
WITH w AS (SELECT note_id, trimmed AS a, lead(trimmed) OVER (PARTITION BY note_id ORDER BY i) AS b FROM ({WORDS}))
SELECT note_id, a || ' ' || b AS name FROM w WHERE regexp_matches(a, '^[A-Z][a-z]+$') AND regexp_matches(b, '^[A-Z][a-z]+$') AND a NOT IN ({", ".join(map(lit, fixed.NOT_NAMES))}) AND b NOT IN ({", ".join(map(lit, fixed.NOT_NAMES))})""",
    "merge_spans": """
WITH RECURSIVE s AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, CAST(l_quantity AS INT) + l_linenumber + 2 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS INT), l_returnflag <> 'R', l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem
), g AS (
  SELECT l_orderkey, r, l_linenumber, a, b, b AS reach, true AS kept FROM s WHERE r = 1
  UNION ALL
  SELECT s.l_orderkey, s.r, s.l_linenumber, s.a, s.b, CASE WHEN s.a >= g.reach THEN s.b ELSE g.reach END, s.a >= g.reach FROM g JOIN s ON s.l_orderkey = g.l_orderkey AND s.r = g.r + 1
)
SELECT l_orderkey, l_linenumber, a AS start_at, b AS end_at FROM g WHERE kept""",
    "severity_rollup": "SELECT coalesce(category, 'all') AS category, coalesce(severity, 'all') AS severity, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT {lit(RULES[r].category)} AS category, {lit(RULES[r].severity)} AS severity FROM ({structural(RULES[r])})" for r in ("email", "pan-india", "ssn-us", "jwt", "aws-access-key", "slack-token"))
    + ") GROUP BY ROLLUP (category, severity)",
    "mask_hash": f"SELECT note_id, CASE WHEN v IS NULL THEN text ELSE replace(text, v, '[EMAIL_' || left(sha256(v), 8) || ']') END AS hidden FROM ({NOTES}) LEFT JOIN ({places(RULES['email'], NOTES, 'note_id')}) USING (note_id)",
    "mask_stars": f"SELECT note_id, CASE WHEN v IS NULL THEN text ELSE replace(text, v, '***') END AS hidden FROM ({NOTES}) LEFT JOIN ({places(RULES['email'], NOTES, 'note_id')}) USING (note_id)",
    "mint_tokens": MINT,
    "redact_placeholder": f"SELECT note_id, CASE WHEN token IS NULL THEN text ELSE replace(text, s.value, token) END AS redacted FROM ({NOTES}) AS n LEFT JOIN ({_SPANS3}) AS s USING (note_id) LEFT JOIN ({MINT}) AS m ON m.session_id = s.session_id AND m.entity_type = s.entity_type AND m.value = s.value",
    "redact_restore": f"SELECT note_id, text FROM ({NOTES})",
    "known_value_redact": f"SELECT note_id, replace(replace(replace(replace(text, 'user7@example.com', '<<EMAIL_1>>'), 'the server', '<<PERSON_2>>'), 'server', '<<PERSON_1>>'), 'on', '<<PORT_1>>') AS redacted FROM ({NOTES})",
    "restore_answer": f"SELECT note_id, {_ANSWER_RESTORED} AS text FROM ({NOTES})",
    "unrestored_tokens": f"SELECT note_id, '<<EMAIL_' || CAST(note_id % 3 AS VARCHAR) || '>>' AS token FROM ({NOTES}) WHERE note_id % 3 <> 1",
    "carry_over_spans": f"""
WITH t AS ({_TURNS}), e AS (SELECT *, last_value(asked IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS expected FROM t)
SELECT conv_id, turn, 'proximity-' || expected AS rule_id, CASE expected WHEN 'password' THEN 'Password' ELSE 'Access Token' END || ' (carried from previous turn)' AS label, 'hunter' || CAST(conv_id AS VARCHAR) || 'isnotsecure' AS value FROM e WHERE answers AND expected IS NOT NULL""",
    "hash_embedding": f"WITH texts AS (SELECT note_id AS k, text AS t FROM ({NOTES})), {_GRAMS} SELECT k AS note_id, bucket, round(x, 6) AS weight FROM vectors",
    "centroid_build": f"WITH {_CENTROIDS}, texts AS (SELECT category || '|' || CAST(i AS VARCHAR) AS k, e AS t FROM examples), {_GRAMS}, {_MEANS} SELECT category, bucket, round(x, 6) AS weight FROM centroids",
    "routing_scores": f"""
WITH {_CENTROIDS}, texts AS (SELECT category || '|' || CAST(i AS VARCHAR) AS k, e AS t FROM examples UNION ALL SELECT '|' || CAST(note_id AS VARCHAR), text FROM ({NOTES})), {_GRAMS},
{_MEANS.replace("FROM vectors JOIN", "FROM (SELECT * FROM vectors WHERE k NOT LIKE '|%') AS vectors JOIN")},
own AS (SELECT CAST(split_part(k, '|', 2) AS BIGINT) AS note_id, bucket, x FROM vectors WHERE k LIKE '|%')
SELECT note_id, category, round(sum(own.x * coalesce(c.x, 0)), 6) AS score FROM own CROSS JOIN (SELECT DISTINCT category FROM centroids) LEFT JOIN centroids AS c USING (category, bucket) GROUP BY 1, 2""",
    "nearest_centroid": """
WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), c AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m),
s AS (SELECT e.vec_id, c.label, round(sum(e.x * c.x), 6) AS score FROM e JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, CAST(label AS BIGINT) AS category, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s) WHERE r = 1""",
    "policy_decision": """
WITH o AS (SELECT l_orderkey, count(*) FILTER (WHERE l_discount > 0.02) AS n, count(*) FILTER (WHERE l_tax >= 0.08) AS b, max(CASE WHEN l_quantity > 48 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END) FILTER (WHERE l_discount > 0.02) AS h FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN b > 0 THEN 'block' WHEN n = 0 THEN 'allow' WHEN h = 2 THEN 'block' ELSE 'redact' END AS action, coalesce(h, -1) AS highest FROM o""",
    "audit_trail": "SELECT note_id, rule_id, entity_type, severity, true AS hidden FROM (" + " UNION ALL ".join(f"SELECT note_id, {lit(r)} AS rule_id, {lit(t)} AS entity_type, {lit(RULES[r].severity)} AS severity FROM ({places(RULES[r], NOTES, 'note_id')})" for r, t in (("email", "EMAIL"), ("pan-india", "PAN"), ("jwt", "JWT"))) + ")",
    "select_tools": """
WITH t AS (SELECT p_partkey AS position, p_name || '_' || p_brand AS name, lower(p_name || '_' || p_brand) AS l FROM part),
m AS (SELECT position, name, l LIKE 'cold%' OR l = '*_brand#1?' OR (l LIKE '%#_brand##1?' ESCAPE '#') OR l = 'small widget_brand#5' AS deny FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY deny ORDER BY position, name) AS r FROM m)
SELECT position, CASE WHEN deny THEN 'denied' WHEN r <= 128 THEN 'selected' ELSE 'truncated' END AS status FROM n""",
    "tool_limits": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN CAST(n_nationkey + 1 AS BIGINT) WHEN 1 THEN CAST(coalesce(nullif(n_nationkey, 0), -1) AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS most FROM nation",
    "settings_resolve": f"SELECT key, raw, rejected, resolved FROM (VALUES {_SETTINGS_ROWS}) AS t(key, raw, resolved, rejected)",
    "json_mask_static": """
SELECT c_custkey, '[USERNAME_' || left(sha256(c_name), 8) || ']' AS user_name, '[INFRA_' || left(sha256(c_mktsegment), 8) || ']' AS host, c_nationkey AS port, '[EMAIL_' || left(sha256(c_name), 8) || ']|' AS mails FROM customer""",
    "entity_types": "SELECT rule_id, entity_type FROM (VALUES "
    + ", ".join(
        f"({lit(r)}, {lit(t)})"
        for t, rs in {
            "AWS_KEY": "aws-access-key aws-secret-key", "PRIVATE_KEY": "private-key-block proximity-private-key", "API_KEY": "generic-api-key openai-api-key stripe-api-key proximity-api-key proximity-key proximity-apikey", "JWT": "jwt", "SLACK_TOKEN": "slack-token",
            "GITHUB_TOKEN": "github-token", "PASSWORD": "generic-password-assignment proximity-password proximity-passwd proximity-pwd proximity-pwrd proximity-pd proximity-pass", "SECRET": "env-var-secret proximity-secret proximity-cred proximity-client-secret",
            "DB_CONNECTION_STRING": "db-connection-string sqlserver-connection-string proximity-connection-string", "USERNAME": "username-assignment proximity-username proximity-user-name proximity-userid proximity-user-id proximity-account-name proximity-service-account proximity-user",
            "EMAIL": "email", "PAN": "pan-india", "IFSC": "ifsc-india", "SSN": "ssn-us", "CARD_NUMBER": "credit-card", "AMOUNT_INR": "amount-inr", "AMOUNT_USD": "amount-usd", "AADHAAR": "aadhaar-india", "PASSPHRASE": "proximity-passphrase",
            "CREDENTIAL": "proximity-creds proximity-credential proximity-credentials", "TOKEN": "proximity-access-token proximity-auth-token proximity-bearer-token proximity-token proximity-tokn", "IP_ADDRESS": "private-ip-standalone public-ip-standalone",
            "HOSTNAME": "internal-url external-url internal-hostname", "FILE_PATH": "unix-file-path windows-file-path", "MAC_ADDRESS": "mac-address", "IPV6": "ipv6-standalone ipv6-link-local", "PORT": "port-contextual", "INFRA": "semantic-infrastructure",
        }.items()
        for r in rs.split()
    )
    + ") AS t(rule_id, entity_type)",
}


#: Expected kinds of the notes: (template, rule). The cards of template 3 depend on their digits.
EXPECTED_KINDS = _detected()
_OTHERS = {
    "aadhaar-india-contextual": ("high", "PII"), "port-contextual": ("low", "INFRA"), "internal-hostname-contextual": ("medium", "INFRA"), "proximity-password": ("medium", "SECRET"), "internal-url": ("medium", "INFRA"), "external-url": ("low", "INFRA"),
    "unix-file-path": ("low", "INFRA"), "windows-file-path": ("low", "INFRA"), "private-ip-standalone": ("medium", "INFRA"), "public-ip-standalone": ("low", "INFRA"), "mac-address": ("medium", "INFRA"), "ipv6-link-local": ("low", "INFRA"),
    "contextual-phone": ("medium", "PII"), "contextual-passport-us": ("high", "PII"), "contextual-account-number": ("high", "PII"), "contextual-customer-id": ("medium", "PII"),
}


def _kind(rule_id: str) -> str:
    severity, category = _OTHERS.get(rule_id) or (RULES[rule_id].severity, RULES[rule_id].category)
    return f"{lit(rule_id)} AS rule_id, {lit(severity)} AS severity, {lit(category)} AS category"


ORACLES["detect_notes"] = (
    f"WITH n AS (SELECT note_id, note_id % 30 AS t, '4532 0151 1283 ' || lpad(CAST(note_id % 10000 AS VARCHAR), 4, '0') AS v FROM ({NOTES})), f AS ("
    + " UNION ALL ".join(f"SELECT note_id, {_kind(r)} FROM n WHERE t = {t}" for t, r in [*EXPECTED_KINDS, (3, "credit-card")])
    + f" UNION ALL SELECT note_id, {_kind('credit-card')} FROM n WHERE t = 3 AND {KEEP['credit-card']} UNION ALL SELECT note_id, {_kind('aadhaar-india')} FROM n WHERE t = 3 AND NOT {KEEP['credit-card']}"
    + ") SELECT rule_id, severity, category, count(*) AS n, count(DISTINCT note_id) AS n_notes FROM f GROUP BY 1, 2, 3"
)


# --- places and values of what the notes hold

#: By template: rule, value as SQL over the orders, and how far the span goes beyond the value.
VALUES = (
    (0, "pan-india", f"'ABCDE' || {d(f'{N} % 10000', 4)} || 'F'", 0),
    (1, "aadhaar-india-contextual", d(N, 12), 0),
    (3, "credit-card", "'4532015112830366'", 0),
    (4, "port-contextual", text_of(f"1000 + {N} % 9000"), 0),
    (5, "internal-hostname-contextual", f"'prod-db-' || {d(f'{N} % 100', 2)}", 0),
    (6, "proximity-password", f"'hunter' || {text_of(N)} || 'isnotsecure'", 0),
    (7, "internal-url", f"'api' || {text_of(f'{N} % 50')} || '.corp.example.com:8443'", 0),
    (7, "external-url", "'example.org'", 0),
    (8, "unix-file-path", f"'/root/.ssh/id_' || {text_of(N)}", 0),
    (8, "unix-file-path", f"'/opt/acme-' || {text_of(f'{N} % 7')} || '/config.yml'", 0),
    (9, "private-ip-standalone", f"'192.168.' || {text_of(f'{N} % 256')} || '.' || {text_of(f'{C} % 256')}", 0),
    (9, "mac-address", f"'00:1b:44:11:3a:' || {text_of(f'10 + {N} % 90')}", 0),
    (10, "generic-password-assignment", f"'letmein' || {text_of(N)}", 0),
    (11, "generic-api-key", f"'key' || {d(N, 20)}", 0),
    (12, "username-assignment", f"'svc_corp_' || chr(CAST(97 + {N} % 26 AS INT)) || {text_of(f'{N} % 100')}", 0),
    (13, "env-var-secret", f"'tok' || {d(N, 10)}", 0),
    (14, "db-connection-string", f"'postgres://user' || {text_of(N)} || ':pw' || {text_of(C)} || '@db.example.com/app'", 0),
    (15, "sqlserver-connection-string", "text", 0),
    (16, "aws-access-key", f"'AKIA' || {d(N, 16)}", 0),
    (16, "slack-token", f"'xoxb-' || {d(N, 12)}", 0),
    (16, "github-token", f"'ghp_' || {d(N, 36)}", 0),
    (17, "jwt", f"'eyJ' || {d(N, 6)} || '.abc.def'", 0),
    (17, "amount-usd", f"'$' || {text_of(N)} || '.50'", 0),
    (17, "amount-inr", f"'Rs. ' || {text_of(f'10 + {N} % 90')} || ',500'", 0),
    (18, "ifsc-india", f"'SBIN0' || {d(f'{N} % 1000000', 6)}", 0),
    (18, "ssn-us", f"{d(f'{N} % 1000', 3)} || '-' || {d(f'{N} % 100', 2)} || '-' || {d(f'{N} % 10000', 4)}", 0),
    (19, "email", f"'user' || {text_of(f'{N} % 500')} || '@example.com'", 0),
    (19, "contextual-phone", d(f"{N} + 9000000", 10), 0),
    (20, "aws-secret-key", d(N, 40), 0),
    (21, "openai-api-key", f"'sk-proj-' || {d(N, 24)}", 0),
    (21, "stripe-api-key", f"'pk_live_' || {d(N, 14)}", 0),
    (22, "private-key-block", "text", 0),
    (23, "contextual-passport-us", f"'A' || {d(f'{N} % 100000000', 8)}", 0),
    (24, "contextual-account-number", d(N, 8), 1),
    (24, "contextual-customer-id", text_of(f"1000 + {N} % 5000"), 0),
    (26, "proximity-password", f"'pw' || {d(N, 6)} || 'abcd'", 0),
    (27, "ipv6-link-local", f"'fe80::1a2b:' || {text_of(f'1000 + {N} % 9000')}", 0),
    (27, "private-ip-standalone", f"'10.0.' || {text_of(f'{N} % 256')} || '.1'", 0),
    (27, "public-ip-standalone", f"'8.8.' || {text_of(f'{N} % 256')} || '.8'", 0),
    (28, "aadhaar-india", f"'1234 5678 ' || {d(f'{N} % 10000', 4)}", 0),
    (29, "windows-file-path", f"'C:' || chr(92) || 'Data' || chr(92) || 'bob' || {text_of(N)} || chr(92) || 'a.txt'", 0),
)
_CARD = f"'4532 0151 1283 ' || {d(f'{N} % 10000', 4)}"
_TEXTS = NOTES.replace(" AS text FROM", f" AS text, {N}, {C}, {N} % 30 AS t FROM")
_FOUND = " UNION ALL ".join(
    # a value that stands at the end is looked for from there: its digits may stand before it, too
    f"SELECT note_id, t, {lit(r)} AS rule_id, {v} AS value, {'length(text) - length(' + v + ')' if (k, r) == (24, 'contextual-customer-id') else f'strpos(text, {v}) - 1'} AS start_at, {more} AS more FROM x WHERE t = {k}"
    for k, r, v, more in VALUES
)
_SECOND = f"SELECT note_id, t, CASE WHEN {KEEP['credit-card']} THEN 'credit-card' ELSE 'aadhaar-india' END AS rule_id, CASE WHEN {KEEP['credit-card']} THEN v ELSE v[1:14] END AS value, strpos(text, v) - 1 AS start_at, 0 AS more FROM (SELECT *, {_CARD} AS v FROM x WHERE t = 3)"
PLACES = f"WITH x AS ({_TEXTS}), places AS (SELECT note_id, t, rule_id, CAST(start_at AS BIGINT) AS start_at, CAST(start_at + length(value) + more AS BIGINT) AS end_at, value FROM ({_FOUND} UNION ALL {_SECOND}))"
_ROUTED = {"port-contextual": "infrastructure", "internal-hostname-contextual": "infrastructure", "proximity-password": "credentials", "contextual-phone": "pii", "contextual-passport-us": "pii", "contextual-account-number": "pii", "contextual-customer-id": "pii"}

ORACLES |= {
    "detect_places": f"{PLACES} SELECT note_id, rule_id, start_at, end_at, value FROM places",
    "udf_scan": f"{PLACES} SELECT note_id, rule_id, start_at, value FROM places WHERE rule_id IN ('email', 'pan-india', 'port-contextual')",
    "highlight_spans": f"{PLACES} SELECT note_id, rule_id, start_at FROM places WHERE rule_id NOT IN ('internal-url', 'external-url')",
    # a range of the first line: what goes over several lines isn't in it
    "anonymize_ranges": f"{PLACES} SELECT note_id, CASE WHEN start_at IS NULL THEN text ELSE left(text, start_at) || '***' || substr(text, end_at + 1) END AS hidden FROM ({NOTES}) LEFT JOIN (SELECT * FROM places WHERE start_at < 10 AND t NOT IN (22, 26)) USING (note_id)",
    "detect_lines": f"""
{PLACES}, lines AS (SELECT note_id, t, i, regexp_replace(line, '\\r$', '') AS line FROM (SELECT note_id, t, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT note_id, t, string_split(text, chr(10)) AS l FROM x))),
{_CENTROIDS}, texts AS (SELECT category || '|' || CAST(i AS VARCHAR) AS k, e AS t FROM examples UNION ALL SELECT '|' || CAST(note_id AS VARCHAR) || '|' || CAST(i AS VARCHAR), line FROM lines), {_GRAMS},
{_MEANS.replace("FROM vectors JOIN", "FROM (SELECT * FROM vectors WHERE k NOT LIKE '|%') AS vectors JOIN")},
own AS (SELECT CAST(split_part(k, '|', 2) AS BIGINT) AS note_id, CAST(split_part(k, '|', 3) AS BIGINT) AS i, bucket, x FROM vectors WHERE k LIKE '|%'),
scored AS (SELECT note_id, i, category, sum(own.x * c.x) AS score FROM own JOIN centroids AS c USING (bucket) GROUP BY ALL),
gated(rule_id, category) AS (VALUES {", ".join(f"({lit(r)}, {lit(c)})" for r, c in _ROUTED.items())})
SELECT p.note_id, p.rule_id, p.start_at FROM places AS p LEFT JOIN gated AS g USING (rule_id) LEFT JOIN scored AS s ON s.note_id = p.note_id AND s.i = CASE WHEN p.t = 26 THEN 3 ELSE 1 END AND s.category = g.category
WHERE g.category IS NULL OR s.score >= {fixed.ROUTE_MIN}""",
    "phrase_spans": " UNION ALL ".join(f"SELECT CAST(n_nationkey * 100 + {i} AS BIGINT) AS phrase_id, {lit(r)} AS rule_id, CAST(strpos({t}, {v}) - 1 AS BIGINT) AS start_at, {v} AS value FROM nation" for i, (t, r, v) in enumerate(phrase_rows())).replace("AS STRING", "AS VARCHAR"),
    "page_urls": r"""
WITH h AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^.*@', '')) AS host FROM pages)
SELECT page_id, CASE WHEN len(list_intersect(string_split_regex(host, '[.\-_]'), ['internal', 'corp', 'intranet', 'lan', 'vpn', 'svc', 'cluster'])) > 0 OR ends_with(host, '.local') THEN 'internal-url' ELSE 'external-url' END AS rule_id, host AS value
FROM h WHERE host <> ''""",
    "json_mask_dynamic": """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT c_custkey AS doc, '{"who":{"username":"<<USERNAME_' || CAST(r AS VARCHAR) || '>>","notes":"write to <<EMAIL_' || CAST(r AS VARCHAR) || '>>"},"balance":' || CAST(c_acctbal AS VARCHAR) || '}' AS redacted FROM n""",
    "udf_redact": """
SELECT o_orderkey, 'mail [EMAIL_' || left(sha256('user' || CAST(o_orderkey AS VARCHAR) || '@example.com'), 8) || '] today' AS hidden,
  'see u' || CAST(o_orderkey AS VARCHAR) || '@x.de and u' || CAST(o_orderkey AS VARCHAR) || '@x.de or ' || CASE WHEN o_orderkey = 1 THEN 'u1@x.de' ELSE '<<EMAIL_' || CAST(o_orderkey AS VARCHAR) || '>>' END AS shown FROM orders""",
    "tool_calls": """SELECT c_custkey AS doc, '{"sent":"to <<EMAIL_1>> and <<EMAIL_2>>"}' AS answer, 'python' AS language FROM customer""",
    "history_replay": """
WITH t AS (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) % 2 AS first FROM conversations)
SELECT conv_id, turn, CASE
  WHEN conv_id % 2 = 0 THEN replace('write to a' || CAST(turn % 2 AS VARCHAR) || '@example.com or a1@example.com', 'a1@example.com', '<<EMAIL_7>>')
  ELSE 'write to <<EMAIL_' || CASE WHEN turn % 2 = first THEN '1' ELSE '2' END || '>> or <<EMAIL_' || CASE WHEN first = 1 THEN '1' ELSE '2' END || '>>' END AS redacted FROM t""",
    "semantic_values": "SELECT s_suppkey, 'semantic-credential' AS rule_id, 'medium' AS severity, CAST(19 AS BIGINT) AS start_at, 'Zx' || CAST(s_suppkey AS VARCHAR) || 'qwert99' AS value FROM supplier",
}
