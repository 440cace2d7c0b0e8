"""Operators over small tables: scanning, merging, redacting, policy, JSON, conversations, settings, streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from redactory.operators import conversation, json_mask, policy, redact, selection
from redactory.operators.embedding import best_seeds, embed, embed_text, route, scores, seed_table, semantic_spans, semantic_words
from redactory.operators.scan import ScanConfig, detect, findings
from redactory.sources import settings
from redactory.sources.embedder import HttpEmbedder, vectors_at
from redactory.sources.files import append_audit, edit, grep, load_mappings, read_audit, read_texts, save_mappings


def spans_of(spark, texts, config=None, **columns):
    rows = [(i, t, *(v[i] for v in columns.values())) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string" + "".join(f", {c} string" for c in columns))
    return {r.id: [(s.rule_id, s.value, s.start, s.end) for s in r.spans] for r in detect(df, config=config).collect()}


def test_structural_rules_and_odd_texts(spark):
    texts = ["card 4532015112830366 ok", "card 4532015112830367 no", None, "", "a@b.co, é@x.de a@b.co", "x" * 60_000 + " a@b.co", "/a" * 20_000 + "/", ";" * 30_000 + "Server=a;" + "x;" * 5_000 + "Password=1", "😀 a@b.co", "pay $80k"]
    got = spans_of(spark, texts)
    assert [s[0] for s in got[0]] == ["credit-card"] and got[1] == [] and got[2] == [] and got[3] == []
    assert [s[1:] for s in got[4]] == [("a@b.co", 0, 6), ("a@b.co", 15, 21)]
    assert got[5] == [("email", "a@b.co", 60_001, 60_007)] and got[6] == []
    assert [s[0] for s in got[7]] == ["sqlserver-connection-string"]
    assert got[8] == [("email", "a@b.co", 2, 8)] and [s[0] for s in got[9]] == ["amount-usd"]


def test_spans_are_disjoint_and_hold_their_values(spark, sf_dir):
    from redactory.plans.notes import notes

    for r in detect(notes(spark, sf_dir)).select("text", "spans").collect():
        at = 0
        for s in r.spans:
            assert at <= s.start < s.end <= len(r.text)
            at = s.end
            if not s.rule_id.startswith(("contextual", "port")):
                assert r.text[s.start : s.end] == s.value


def test_disabled_rules_keep_their_place(spark):
    text = ['token = "abcdefgh12345678abcd" and a@b.co']
    assert [s[0] for s in spans_of(spark, text)[0]] == ["proximity-token", "email"]
    assert [s[0] for s in spans_of(spark, text, ScanConfig(disabled=("email",)))[0]] == ["proximity-token"]


def test_comments_let_prose_through_but_not_credentials(spark):
    texts = ["# ask prod-db-01 server, password = hunter2isnotsecure1\nport: 8080"]
    got = spans_of(spark, texts, ScanConfig(by_line=True, language_col="lang"), lang=["config.yaml"])
    assert [s[0] for s in got[0]] == ["generic-password-assignment", "port-contextual"]


def test_lines_keep_windows_apart(spark):
    text = ["my password is\nhunter2isnotsecure"]
    assert spans_of(spark, text, ScanConfig(by_line=True))[0] == []
    assert [s[0] for s in spans_of(spark, text)[0]] == ["proximity-password"]


def test_findings_hide_values(spark):
    df = detect(spark.createDataFrame([(1, "a@b.co")], "id int, text string"))
    assert "value" not in findings(df, "id").columns and findings(df, "id", with_values=True).first().value == "a@b.co"


def sessions(spark):
    rows = [("s", 1, "a@b.co and c@d.co"), ("s", 2, "again c@d.co, pan ABCDE1234F"), ("t", 1, "only c@d.co"), ("t", 2, None)]
    return detect(spark.createDataFrame(rows, "session string, turn int, text string"))


def test_mint_redact_restore(spark):
    found = sessions(spark)
    mappings = redact.mint(redact.typed(found, "session", "turn"), "session", "turn").cache()
    assert {(r.session, r.value): r.token for r in mappings.collect()} == {("s", "a@b.co"): "<<EMAIL_1>>", ("s", "c@d.co"): "<<EMAIL_2>>", ("s", "ABCDE1234F"): "<<PAN_1>>", ("t", "c@d.co"): "<<EMAIL_1>>"}
    hidden = redact.redact(found, mappings, "session", ["session", "turn"])
    assert {(r.session, r.turn): r.redacted for r in hidden.collect()}[("s", 2)] == "again <<EMAIL_2>>, pan <<PAN_1>>"
    back = hidden.join(redact.pairs_of(mappings, "session"), "session").select("text", redact.restore(F.col("redacted"), F.col("pairs")).alias("back"))
    assert all((r.text or "") == r.back for r in back.collect())
    more = detect(spark.createDataFrame([("s", 3, "c@d.co then new@d.co")], "session string, turn int, text string"))
    grown = redact.mint(redact.typed(more, "session", "turn"), "session", "turn", issued=mappings)
    assert {r.token for r in grown.where("session = 's'").collect()} == {"<<EMAIL_1>>", "<<EMAIL_2>>", "<<EMAIL_3>>", "<<PAN_1>>"}


def test_restore_is_tolerant_and_leaves_strangers(spark):
    pairs = [("<<EMAIL_1>>", "a@b.co"), ("<<PAN_1>>", "X")]
    text = "<<EMAIL_1>> << email_1 >> <<EMAIL_2>> <<pan_1>>"
    df = spark.createDataFrame([(text, pairs)], "text string, pairs array<struct<token:string,value:string>>")
    assert df.select(redact.restore(F.col("text"), F.col("pairs"))).first()[0] == "a@b.co a@b.co <<EMAIL_2>> X" == redact.restore_text(text, pairs)
    assert df.select(redact.unrestored(F.lit("<<EMAIL_2>> <<EMAIL_2>> <<PAN_9>>"), F.array(F.lit("EMAIL")))).first()[0] == ["<<EMAIL_2>>"]


def test_policy(spark):
    df = detect(spark.createDataFrame([(1, "ABCDE1234F and a@b.co"), (2, "nothing"), (3, "a@b.co")], "id int, text string"))
    got = {r.id: (r.soft.action, r.hard.action, r.hard.reason) for r in df.select("id", policy.decide(F.col("spans"), F.col("business")).alias("soft"), policy.decide(F.col("spans"), F.col("business"), block_high=True).alias("hard")).collect()}
    assert got[1] == ("redact", "block", "Blocked: 1 high-severity match(es) found (e.g. PAN (India Tax ID)).") and got[2][0] == "allow" and got[3][1] == "redact"


def test_embeddings_agree_and_business_is_flagged(spark):
    texts = ["Password reset for the admin panel", "", "ünï 42 a"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(embed(F.col("t")).alias("v")).collect()
    for t, r in zip(texts, got, strict=True):
        assert r.v == pytest.approx(embed_text(t))
    text = "quarterly revenue targets and expansion plans for next year"
    row = spark.createDataFrame([(text,)], "text string")
    assert row.select(scores(embed(F.col("text")))[0]["category"]).first()[0] == "business-strategy"
    assert len(row.select(route(embed(F.col("text")), 0.0, 3)).first()[0]) == 3
    assert row.select(F.size(scores(F.array(F.lit(1.0))))).first()[0] == 0
    assert detect(row, config=ScanConfig(business=True)).first().business[0].rule_id == "business-strategy-contextual"


def test_semantic_layer(spark):
    text = "the passphrase maybe hunter2isnotsecure"
    words = spark.createDataFrame([(w, embed_text(w)) for w in semantic_words(text)], "word string, vector array<double>")
    seeds = seed_table(spark).withColumn("vector", embed(F.col("seed")))
    nearest = {r.word: (r.group, r.label, r.category, r.severity, r.score) for r in best_seeds(words, seeds).collect()}
    assert nearest["passphrase"][0] == "credential" and nearest["passphrase"][4] == pytest.approx(1)
    assert [x[0] for x in semantic_spans(text, [], nearest)] == ["semantic-credential"]


def test_json(spark):
    doc = {"user": {"password": "pw", "notes": ["mail a@b.co", {"api_key": ""}], "n": 1}, "x": None, "host": ["h1", "h2"]}
    df = spark.createDataFrame([("s", 1, json.dumps(doc)), ("s", 2, "no json"), ("s", 3, None)], "session string, doc int, json string")
    out, mappings = json_mask.redact_json(df, "session", ["session", "doc"])
    got = {r.doc: r.redacted for r in out.collect()}
    assert json.loads(got[1]) == {"user": {"password": "<<PASSWORD_1>>", "notes": ["mail <<EMAIL_1>>", {"api_key": ""}], "n": 1}, "x": None, "host": ["<<INFRA_1>>", "<<INFRA_2>>"]}
    assert got[2] == "no json" and got[3] is None
    back = out.join(redact.pairs_of(mappings, "session"), "session").select("doc", json_mask.restore_json(out, "redacted", "pairs").alias("back"))
    assert json.loads({r.doc: r.back for r in back.collect()}[1]) == doc


def test_conversations_decay(spark):
    texts = ["the password is", "hmm", "try hunter1isnotsecure", "try hunter1isnotsecure", "now"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id int, turn int, text string")
    got = {r.turn: [s.value for s in r.spans] for r in conversation.detect_conversations(df).collect()}
    assert got == {0: [], 1: [], 2: ["hunter1isnotsecure"], 3: [], 4: []}
    assert {r.turn: len(r.spans) for r in conversation.detect_conversations(df, carry_turns=0).collect()}[2] == 0


def test_tools_and_settings(spark):
    tools = spark.createDataFrame([(i, n) for i, n in enumerate(["read_file", "mcp_a", "mcp_b", "grep", "shell"])], "position int, name string")
    status = lambda most, deny: {r.name: r.status for r in selection.select_tools(tools, most, deny).collect()}
    assert status(2.9, ["MCP_*", " "]) == {"read_file": "selected", "mcp_a": "denied", "mcp_b": "denied", "grep": "selected", "shell": "truncated"}
    assert set(status(-1, []).values()) == {"truncated"}
    good, bad = settings.sanitize({"maxTools": float("nan"), "toolDenyList": ["a", 1], "routingMinSimilarity": True, "enablePiiDetection": False})
    assert bad == ["routingMinSimilarity", "maxTools", "toolDenyList"] and good["maxTools"] == 128 and good["enablePiiDetection"] is False
    assert settings.scan_config(good).pii is False


def test_embedding_service_formats():
    assert vectors_at({"data": [{"e": [1, 2]}, {"e": [3]}]}, "data[].e") == [[1, 2], [3]]
    assert vectors_at({"a": {"b": [[1.0]]}}, "a.b") == [[1.0]] and vectors_at({"a": [["x"]]}, "a") is None and vectors_at({}, "") is None
    rows = HttpEmbedder("http://x/", format="rows", auth="bearer", token="t")
    assert rows.read({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}) == [[1], [2]]
    assert rows.address() == "http://x/embeddings" and rows.headers()["Authorization"] == "Bearer t" and "t" not in repr(rows).split("token")[0][-3:]
    assert HttpEmbedder("u", format="custom", request_field="q", model="m").body(["a"]) == {"q": ["a"], "model": "m"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one password\ntwo\n")
    texts = read_texts(spark, str(tmp_path), "*.txt")
    assert [(r.line_no, r.line) for r in grep(texts, "pass").collect()] == [(1, "one password")]
    assert edit(texts, "two", "2").first().text == "one password\n2\n" and edit(texts, "o", "0").first().error == "old text is not unique"
    found = sessions(spark)
    mappings = redact.mint(redact.typed(found, "session", "turn"), "session", "turn")
    save_mappings(mappings, str(tmp_path / "m"))
    assert load_mappings(spark, str(tmp_path / "m")).count() == 4
    entry = found.select(policy.audit_entry(policy.decide(F.col("spans"), F.col("business")), policy.audit_details(F.col("spans")), "test").alias("e")).select("e.*")
    assert append_audit(entry, str(tmp_path / "audit")) and append_audit(entry, str(tmp_path / "audit"))
    back = read_audit(spark, str(tmp_path / "audit"))
    assert back.count() == 8 and back.where("exists(details, d -> d.value IS NOT NULL)").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from redactory.streaming.session import redact_stream

    rows = [("s", 1, "a@b.co and the password is"), ("s", 2, "use hunter1isnotsecure"), ("s", 3, "c@d.co, a@b.co"), ("t", 1, "c@d.co")]
    spark.createDataFrame(rows, "session string, turn long, text string").write.parquet(str(tmp_path / "in"))
    stream = redact_stream(spark.readStream.schema("session string, turn long, text string").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.session, r.turn): r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    found = conversation.detect_conversations(spark.createDataFrame(rows, "session string, turn long, text string"), conversation="session").cache()
    hidden = redact.redact(found, redact.mint(redact.typed(found, "session", "turn"), "session", "turn"), "session", ["session", "turn"])
    assert got == {(r.session, r.turn): r.redacted for r in hidden.collect()}
    assert got[("s", 2)] == "use <<PASSWORD_1>>" and got[("s", 3)] == "<<EMAIL_2>>, <<EMAIL_1>>"


def test_texts_with_very_many_spans_take_time_in_proportion(spark):
    import time

    from redactory.functions.tokens import PLAIN, lines, placed
    from redactory.operators.spans import merge, no_spans
    from redactory.operators.structural import RULES, structural_spans

    text = " ".join(f"u{i}@x.de" for i in range(100_000))
    df = spark.createDataFrame([(text,)], "text string").select("text", merge(structural_spans(F.col("text"), (RULES["email"],)), no_spans()).alias("spans"))
    df.select(F.size("spans")).first()  # workers start
    began = time.perf_counter()
    row = df.select(F.size("spans").alias("n"), F.length(redact.anonymize(F.col("text"), F.col("spans"), "mask")).alias("left"), F.size(placed(F.col("text"), PLAIN)).alias("tokens"), F.size(lines(F.replace("text", F.lit(" "), F.lit("\n")))).alias("lines")).first()
    assert (row.n, row.left, row.tokens, row.lines) == (100_000, 4 * 100_000 - 1, 100_000, 100_000)
    assert time.perf_counter() - began < 10


def test_long_texts_are_read_whole(spark):
    from redactory.operators.contextual import spans_by_words

    text = "word " * 200_000 + "ask Jane Doe"
    df = spark.createDataFrame([(text,)], "text string")
    assert [s.value for s in df.select(spans_by_words("person_names", F.col("text")).alias("s")).first().s] == ["Jane Doe"]


def test_merge_fills_gaps_with_late_spans(spark):
    from redactory.operators.spans import SPANS, merge, merged

    make = lambda *places: [("r", "l", "low", "PII", str(a), a, b) for a, b in places]
    layers = make((5, 9), (20, 25)), make((0, 5), (5, 12), (8, 10), (30, 31)), make((9, 10), (3, 6), (26, 40), (26, 28))
    df = spark.createDataFrame([layers, ([], [], make((1, 2), (1, 2))), (None, None, None)], f"a {SPANS}, b {SPANS}, c {SPANS}")
    got = [[(s.start, s.end) for s in r.s] for r in df.select(merge(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()]
    assert got == [[(0, 5), (5, 9), (9, 10), (20, 25), (26, 28), (30, 31)], [(1, 2)], []]
    assert [s[5:] for s in merged(*layers)] == got[0]


def test_rules_of_ones_own(spark):
    from redactory.operators.structural import L, R, Rule

    own = Rule("badge", "Badge", "high", "PII", "B[0-9]{5}", L, R, lambda v, w: v != "B00000", marks=("B",))
    got = spans_of(spark, ["badge B12345 or B00000 at a@b.co"], ScanConfig(rules=(own,)))[0]
    assert [s[:2] for s in got] == [("badge", "B12345"), ("email", "a@b.co")]


def test_sql_functions(spark):
    from redactory import udf

    udf.register(spark)
    row = spark.sql("SELECT detect_spans('a@b.co x')[0].rule_id AS r, redact('to a@b.co', 'mask') AS m, redact(NULL, 'mask') AS n, restore('<<EMAIL_1>> <<X_1>>', array(named_struct('token', '<<EMAIL_1>>', 'value', 'a@b.co'))) AS b").first()
    assert (row.r, row.m, row.n, row.b) == ("email", "to ***", "", "a@b.co <<X_1>>")
    assert [(r.rule_id, r.start) for r in spark.sql("SELECT * FROM scan_text('mail a@b.co')").collect()] == [("email", 5)]
    assert spark.sql("SELECT * FROM scan_text(NULL)").count() == 0
    udf.register(spark, ScanConfig(disabled=("email",)))
    assert spark.sql("SELECT * FROM scan_text('mail a@b.co')").count() == 0 == spark.sql("SELECT size(detect_spans('a@b.co')) AS n").first().n
    udf.register(spark)


def test_ranges_and_highlights(spark):
    from redactory.operators.ranges import anonymize_range, highlighted, in_range

    text = "first line a@b.co\nphone: 9876543210 and c@d.co\nlast"
    assert [s[4] for s in in_range(text, 25, 30)] == ["9876543210"] and in_range(text, 0, 5) == [] and [s[0] for s in in_range(text, -5, 10**9)] == ["email", "contextual-phone", "email"]
    assert [s[0] for s in highlighted(text)] == ["email", "contextual-phone", "email"]
    # the rule that is off doesn't keep its place here, and what overlaps the span listed before isn't shown
    assert [s[0] for s in highlighted('token = "abcdefgh12345678abcd" x', ScanConfig(by_line=True, disabled=("proximity-token",)))] == []
    df = spark.createDataFrame([(text, 25, 30), (None, 0, 1), (text, None, 1)], "text string, a int, b int")
    assert [r.hidden for r in anonymize_range(df, F.col("a"), F.col("b"), "mask").collect()] == ["first line a@b.co\nphone: *** and c@d.co\nlast", "", text]


def test_history_and_tool_calls(spark):
    turns = spark.createDataFrame([("s", 1, "a@b.co"), ("s", 2, "c@d.co and a@b.co"), ("t", 1, "x@y.de then a@b.co"), ("t", 2, None)], "session string, turn int, text string")
    issued = spark.createDataFrame([("t", "EMAIL", "a@b.co", "<<EMAIL_4>>", "email", "Email Address", "PII", "low")], "session string, entity_type string, value string, token string, rule_id string, label string, category string, severity string")
    out, mappings = conversation.redact_history(turns, issued, session="session")
    # a session that has issued placeholders isn't scanned again
    assert {(r.session, r.turn): r.redacted for r in out.collect()} == {("s", 1): "<<EMAIL_1>>", ("s", 2): "<<EMAIL_2>> and <<EMAIL_1>>", ("t", 1): "x@y.de then <<EMAIL_4>>", ("t", 2): ""}
    assert mappings.count() == 3
    cold, _ = conversation.redact_history(turns, None, session="session")
    assert {(r.session, r.turn): r.redacted for r in cold.collect()}[("t", 1)] == "<<EMAIL_1>> then <<EMAIL_2>>"
    assert json_mask.tool_language('{"a": {"file": "src/x.py"}}') == "python" and json_mask.tool_language('["go"]') == "go"
    assert json_mask.tool_language('{"a":{"b":{"c":{"d":{"e":"x.py"}}}}}') is None and json_mask.tool_language("no") is None is json_mask.tool_language(None)


def test_settings_reach_the_scan():
    good, _ = settings.sanitize({"semanticMatchThreshold": 0.7, "disabledPiiRules": ["email"]})
    plain = settings.scan_config(good)
    assert not plain.semantic and not plain.routed and not plain.business and plain.semantic_min == 0.7 and plain.disabled == ("email",)
    full = settings.scan_config(good, vector_col="v", nearest_col="n", language_col="l")
    assert full.semantic and full.routed and full.business and full.language_col == "l"
    always, _ = settings.sanitize({"alwaysRunAllDetectors": True, "enableSyntaxAwareRedaction": False, "enableCrossTurnSecretCarryover": False})
    config = settings.scan_config(always, vector_col="v", language_col="l")
    assert not config.routed and not config.business and config.language_col is None
    assert settings.carry_turns(always) == 0 and settings.carry_turns(good) == 2


def test_semantic_words_fill_gaps(spark):
    from redactory.operators.embedding import nearest_words

    text = ["the passcode maybe Zx1qwert99 today", "my password is Zx1qwert99"]
    assert spans_of(spark, text)[0] == []
    assert [s[0] for s in spans_of(spark, text, ScanConfig(semantic=True))[0]] == ["semantic-credential"] and [s[0] for s in spans_of(spark, text, ScanConfig(semantic=True))[1]] == ["proximity-password"]
    assert spans_of(spark, text, ScanConfig(semantic=True, semantic_min=1.1))[0] == []
    df = spark.createDataFrame(list(enumerate(text)), "id int, text string")
    words = spark.createDataFrame([(w, embed_text(w)) for t in text for w in semantic_words(t)], "word string, vector array<double>").distinct()
    near = nearest_words(df, ["id"], words, seed_table(spark).withColumn("vector", embed(F.col("seed"))))
    got = {r.id: [s.rule_id for s in r.spans] for r in detect(near, config=ScanConfig(semantic=True, nearest_col="nearest")).collect()}
    assert got == {0: ["semantic-credential"], 1: ["proximity-password"]}


def test_column_predicates_equal_the_plain_ones(spark):
    import random

    from redactory.functions import predicates as p

    rng = random.Random(2)
    values = ["".join(rng.choice("aB1_.-@#+=/'\"` x(),é") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    values += ["hunter2isnotsecure", "Hunter@123", "QUJDREVGRw==", "svc_corp_uat", "user.name", "'a_b1'", "987-654.", "\"x\ny\""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    rows = df.select("v", p.strip_quotes_column(v).alias("s"), p.secret_shaped(v).alias("secret"), p.account_name(v).alias("name"), p.trim_word_column(v).alias("trim"), p.digits_column(v).alias("digits"), p.assigned_literal(v, F.concat(F.lit("x = '"), v, F.lit('"'))).alias("literal")).collect()
    for r in rows:
        expected = p.strip_quotes(r.v), p.is_secret_shaped(r.v), p.is_account_name(r.v), p.trim_word(r.v), p.digits_of(r.v), p.is_assigned_literal(r.v, f"x = '{r.v}\"")
        assert (r.s, r.secret, r.name, r.trim, r.digits, r.literal) == expected, r.v


def test_files_of_ones_own(spark, tmp_path):
    from redactory.operators.embedding import built_in_centroids, centroids
    from redactory.sources.files import read_centroids, read_examples, read_seeds

    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x)) and str(tmp_path / name)
    own = read_centroids(spark, put("a.json", {"pii": [0.0] * 255 + [1.0], "credentials": [1.0] + [0.0] * 255}))
    assert [k for k, _ in own] == ["pii", "credentials"] and len(own[0][1]) == 256
    for bad in ({"a": [1], "b": [1, 2]}, {"a": []}, {"a": ["x"]}, [1], {}, "no json"):
        assert read_centroids(spark, put("b.json", bad)) is None
    assert read_centroids(spark, str(tmp_path / "missing.json")) is None
    text = ["my password is hunter2isnotsecure"]
    assert spans_of(spark, text, ScanConfig(routed=True))[0] and spans_of(spark, text, ScanConfig(routed=True, by_line=True))[0]
    # no line is near enough to these
    far = tuple((k, tuple([0.0] * 256)) for k, _ in built_in_centroids())
    assert spans_of(spark, text, ScanConfig(routed=True, centroids=far))[0] == [] == spans_of(spark, text, ScanConfig(routed=True, by_line=True, centroids=far))[0]
    examples = read_examples(spark, put("c.json", {"x": ["one two", "two"], "y": ["three"]}))
    assert {r.category for r in centroids(examples).collect()} == {"x", "y"} and read_examples(spark, put("d.json", {"x": "one"})) is None
    seeds = read_seeds(spark, put("e.json", {"g": {"label": "L", "category": "PII", "severity": "low", "seeds": ["a", "b"]}}))
    assert seeds.columns == seed_table(spark).columns and seeds.count() == 2 and read_seeds(spark, put("f.json", {"g": {}})) is None


def test_issued_types(spark):
    rows = [("s", "EMAIL"), ("s", "PAN"), ("s", "EMAIL"), ("t", "PAN")]
    got = redact.issued_types(spark.createDataFrame(rows, "session string, entity_type string"), "session").collect()
    assert {r.session: r.types for r in got} == {"s": ["EMAIL", "PAN"], "t": ["PAN"]}
