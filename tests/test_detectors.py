"""Cases of single detectors, as plain data."""

from __future__ import annotations

import pytest

from redactory.functions.comments import comment_ranges, hash_comments, language_of
from redactory.functions.predicates import digits_of, entity_type, is_account_name, is_secret_shaped, strip_quotes, trim_word, unquoted, within_edits
from redactory.operators.contextual import carried_over, contextual_spans, credentials
from redactory.operators.infra import cut_tail, infra_spans
from redactory.operators.scan import ScanConfig, scan_words

ON = {"pii": True, "infra": True, "secrets": True}


def found(text: str) -> list[tuple[str, str]]:
    structural, context, _ = scan_words(text, ScanConfig(), ON)
    return [(x[0], x[4]) for x in (*structural, *context)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("aadhaar 123456789012 needs updating", [("aadhaar-india-contextual", "123456789012")]),
        ("the invoice total was 123456789012 paise", []),
        ("the server runs on port 8080 today", [("port-contextual", "8080")]),
        ("he scored 8080 runs in the match", []),
        ("the server prod-db-01 needs a restart", [("internal-hostname-contextual", "prod-db-01")]),
        ("step-by-step-3 guide to cooking", []),
        ("hunter2isnotsecure is my password", [("proximity-password", "hunter2isnotsecure")]),
        ("my password is hunter2isnotsecure.", [("proximity-password", "hunter2isnotsecure")]),
        ("the passowrd is hunter2isnotsecure", [("proximity-password", "hunter2isnotsecure")]),
        ("the win was more than a token gesture", []),
        ("tests passed and the build was taken abc12345", []),
        ("the uat service account is svc_corp_uat", [("proximity-service-account", "svc_corp_uat")]),
        ("def login(self, email, password)", []),
        ("username = user.name", []),
        ("`http://${host}/${path}`", []),
        ("http://api.corp.example.com/${path}", [("internal-url", "api.corp.example.com")]),
        ("see https://Example.com/a.", [("external-url", "https://Example.com/a")]),
        ("http://localhost:3000/x and http://127.0.0.1/", []),
        ("/dev/null /usr/bin/python /src/index.ts ./etc/nginx.conf", []),
        ("/root/.ssh/id_rsa /opt/acme-payments/config.yml", [("unix-file-path", "/root/.ssh/id_rsa"), ("unix-file-path", "/opt/acme-payments/config.yml")]),
        ("C:\\Data\\bob\\notes.txt", [("windows-file-path", "C:\\Data\\bob\\notes.txt")]),
        ("inet 192.168.1.50 netmask 255.255.255.0 ether 00:1b:44:11:3a:b7 inet6 fe80::1a2b:3c4d ::1 127.0.0.1", [("internal-hostname", "192.168.1.50"), ("private-ip-standalone", "192.168.1.50"), ("mac-address", "00:1b:44:11:3a:b7"), ("ipv6-link-local", "fe80::1a2b:3c4d")]),
        ("é192.168.1.5", [("private-ip-standalone", "192.168.1.5")]),
        ("call me on 98765-43210 mobile", [("contextual-phone", "9876543210")]),
        ("passport A12345678 was renewed", [("contextual-passport-us", "A12345678")]),
        ("reach db01.internal from cache.corp.example", [("internal-hostname", "db01.internal"), ("internal-hostname", "cache.corp.example")]),
        ("", []),
    ],
)
def test_context(text, expected):
    assert sorted(found(text)) == sorted(expected)


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (is_secret_shaped, "hunter2isnotsecure", True), (is_secret_shaped, "Hunter@123", True), (is_secret_shaped, "api/v2/users", False), (is_secret_shaped, "QUJDREVGRw==", True), (is_secret_shaped, "abc123", False),
        (is_secret_shaped, 'KEY="abc-1234"', False), (is_secret_shaped, "two words1", False), (is_secret_shaped, "description", False),
        (is_account_name, "svc_corp_uat", True), (is_account_name, "kashyap.jain", True), (is_account_name, "string", False), (is_account_name, "user.name", False), (is_account_name, "jdoe", False), (is_account_name, "ab.", False),
        (strip_quotes, "'a'", "a"), (strip_quotes, "'a\"", "'a\""), (strip_quotes, "'", "'"), (trim_word, "(x)", "(x)"), (trim_word, ")x(", "x"), (digits_of, "987-654.", "987654"), (digits_of, "12a", None),
        (cut_tail, "a(b).,", "a(b)"), (cut_tail, "a)])", "a"), (cut_tail, "...", ""),
    ],
)
def test_values(function, text, expected):
    assert function(text) == expected


def test_unquoted_peels_layers_and_stops():
    assert unquoted("'\"sk_live_1\"'", 10) == ("sk_live_1", 12)
    assert unquoted("value).", 0) == ("value", 0)


def test_edit_distance_counts_swaps_once():
    assert within_edits("passowrd", "password", 1)
    assert not within_edits("psasowrd", "password", 1)
    assert not within_edits("passed", "password", 1)


def test_long_and_odd_texts_end_quickly():
    for text in ("/a" * 50_000, ";" * 100_000, "x" * 200_000, "a-" * 50_000, "((((" * 20_000, ":" * 50_000, "1." * 50_000, '"' * 50_001):
        infra_spans(text)
        contextual_spans(text)


def test_names_are_off_unless_asked_for():
    text = "Please ask Jane Doe today"
    assert contextual_spans(text)[0] == []
    assert [x[4] for x in contextual_spans(text, names=True)[0]] == ["Jane Doe"]


def test_keywords_are_seen_without_values():
    assert credentials("get bearer token and the password is")[1] == [("proximity-bearer-token", "Bearer Token (conversational)"), ("proximity-password", "Password (conversational)")]
    assert [r for r, _ in credentials("creds and credentials")[1]] == ["proximity-cred", "proximity-credential"]


def test_placeholders_are_not_carried_over():
    assert carried_over("keep using <<PASSWORD_1>> for now", "proximity-password", "Password (conversational)") == []
    assert carried_over("use 'hunter1isnotsecure'", "proximity-password", "Password (conversational)") == [("proximity-password", "Password (carried from previous turn)", "medium", "SECRET", "hunter1isnotsecure", 4, 24)]


def test_entity_types_follow_their_order():
    assert entity_type("aws-secret-key", "SECRET") == "AWS_KEY"
    assert entity_type("contextual-passport-us", "PII") == "PASSPORT"
    assert entity_type("semantic-pii-identifier", "PII") == "PII"
    assert entity_type("mcp-field-host", "INFRA") == "INFRA"


def test_comments():
    text = "a: 1 # one\nb: '#no' # two\nc#d: 3\n"
    assert [text[a:b] for a, b in hash_comments(text)] == ["# one", "# two"]
    code = "x = 1 // one\ny = \"// no\" /* two\n */"
    assert [code[a:b] for a, b in comment_ranges(code, "go")] == ["// one", "/* two\n */"]
    assert language_of("src/app.tsx") == "tsx" and language_of("csharp") == "c_sharp" and language_of("notes") is None
    assert comment_ranges("# x" * 300_000, "yaml") == []


@pytest.mark.parametrize("name", ["corp_payments_production_cluster_primary_region_readwrite_database_password", "https://config.corp/" + "a" * 60 + "_password_file", '"' + "x" * 70 + '_password"'])
def test_long_names_are_keywords(name):
    assert len(name) > 60
    spans, seen = credentials(f"{name} is hunter2isnotsecure")
    assert [x[4] for x in spans] == ["hunter2isnotsecure"] and [x[0] for x in seen] == ["proximity-password"]
    assert [x[4] for x in contextual_spans(f"{name} is hunter2isnotsecure")[0] if x[0] == "proximity-password"] == ["hunter2isnotsecure"]


def test_emails_are_those_of_the_pattern():
    import random

    from redactory.operators.structural import RULES, _emails

    rng, pattern = random.Random(1), RULES["email"].search
    for _ in range(30_000):
        text = "".join(rng.choice("ab.@-_%é1 ") for _ in range(rng.randint(0, 30)))
        assert list(_emails(text)) == [m.span(1) for m in pattern.finditer(text)], text
    list(_emails("a." * 100_000 + "@"))


def test_white_space_of_rules_is_not_ascii_only():
    from redactory.operators.structural import RULES, spans_in

    assert [s[4] for s in spans_in("1234\xa05678\u20099012")] == ["1234\xa05678\u20099012"]
    assert [s[4] for s in spans_in("password=abc123\u3000x", (RULES["generic-password-assignment"],))] == ["abc123"]
    assert spans_in("PAſſWORD=abc123") == []  # letters of other alphabets aren't folded
