"""The queries of the redaction engine, by name, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory import udf
from redactory.functions import lexicon as fixed
from redactory.functions.predicates import entity_type_column
from redactory.functions.tokens import PLAIN, PROXIMITY, lines, placed
from redactory.operators import conversation, embedding, json_mask, policy, ranges, redact, selection
from redactory.operators.contextual import spans_by_words
from redactory.operators.scan import ScanConfig, detect, findings
from redactory.operators.spans import SPANS, merge, span
from redactory.operators.structural import RULES, find, structural_spans
from redactory.plans.notes import notes, phrases
from redactory.session import materialize, spread
from redactory.sources import settings

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def structural(rule_id: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = notes(spark, sf_dir).select("note_id", F.explode(find(RULES[rule_id], F.col("text"))).alias("s"))
        return found.select("note_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.col("s.value").alias("value"))

    return query


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails and long digit runs with their places in all documents."""
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(structural_spans(F.col("text"), (RULES["email"], RULES["credit-card"]))).alias("s"))
    return found.select("doc_id", F.col("s.rule_id").alias("rule_id"), F.col("s.start").cast("long").alias("start_at"), F.col("s.value").alias("value"))


def detect_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is found in the notes, by rule."""
    found = findings(detect(notes(spark, sf_dir)), "note_id")
    return found.groupBy("rule_id", "severity", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("note_id").alias("n_notes"))


def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "doc_id")


def detect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan line by line, with routing."""
    found = findings(detect(notes(spark, sf_dir), config=ScanConfig(by_line=True, routed=True)), "note_id")
    return found.select("note_id", "rule_id", F.col("start").cast("long").alias("start_at"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts in the url column of pages."""
    found = findings(detect(table(spark, sf_dir, "pages").select("page_id", "url"), "url"), "page_id", with_values=True)
    return found.where(F.col("rule_id").isin("internal-url", "external-url")).select("page_id", "rule_id", "value")


def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note_id", F.explode(lines(F.col("text"))).alias("l")).select("note_id", F.col("l.start").cast("long").alias("start_at"), F.col("l.text").alias("line"))


def tokens(pattern: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = notes(spark, sf_dir).select("note_id", F.posexplode(placed(F.col("text"), pattern)).alias("i", "t"))
        return found.select("note_id", F.col("i").cast("long").alias("i"), F.col("t.text").alias("token"), F.col("t.start").cast("long").alias("start_at"))

    return query


def by_words(detector: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes(spark, sf_dir).select("note_id", F.explode(spans_by_words(detector, F.col("text"))).alias("s"))
    return found.select("note_id", F.col("s.rule_id").alias("rule_id"), F.col("s.start").cast("long").alias("start_at"), F.col("s.value").alias("value"))


def number_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers near a keyword of their group."""
    return by_words("numbers", spark, sf_dir).withColumnRenamed("value", "digits")


def port_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number that can be a port around each mention of a port."""
    return by_words("ports", spark, sf_dir).select("note_id", "start_at", F.col("value").alias("port"))


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two capitalized words in a row."""
    return by_words("person_names", spark, sf_dir).select("note_id", F.col("value").alias("name"))


def detect_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is found in the notes, with its place and value."""
    found = findings(detect(notes(spark, sf_dir)), "note_id", with_values=True)
    return found.select("note_id", "rule_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "value")


def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values around each of the conversational keywords, and what else names a value: licences, addresses, hosts, business words."""
    found = findings(detect(phrases(spark, sf_dir)), "phrase_id", with_values=True)
    return found.select("phrase_id", "rule_id", F.col("start").cast("long").alias("start_at"), "value")


def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an editor shows in the notes, URLs' hosts left out."""
    config = ScanConfig(by_line=True, disabled=("internal-url", "external-url"))
    found = notes(spark, sf_dir).select("note_id", F.explode(ranges.highlights(F.col("text"), config)).alias("s"))
    return found.select("note_id", F.col("s.rule_id").alias("rule_id"), F.col("s.start").cast("long").alias("start_at"))


def anonymize_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten characters of the notes, made anonymous by what their lines say."""
    return ranges.anonymize_range(notes(spark, sf_dir), F.lit(0), F.lit(10), "mask").select("note_id", "hidden")


def udf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails, tax ids and ports in the notes by the table function."""
    udf.register(spark)
    notes(spark, sf_dir).createOrReplaceTempView("redactory_notes")
    return spark.sql("SELECT note_id, s.rule_id, CAST(s.start AS LONG) AS start_at, s.value FROM redactory_notes AS n, LATERAL scan_text(n.text) AS s WHERE s.rule_id IN ('email', 'pan-india', 'port-contextual')")


def udf_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text redacted and another restored by SQL functions."""
    udf.register(spark)
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("redactory_orders")
    return spark.sql("SELECT o_orderkey, redact(concat('mail user', o_orderkey, '@example.com today'), 'hash') AS hidden, restore(concat('see <<EMAIL_1>> and << email_1 >> or <<EMAIL_', o_orderkey, '>>'), array(named_struct('token', '<<EMAIL_1>>', 'value', concat('u', o_orderkey, '@x.de')))) AS shown FROM redactory_orders")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with placeholders in their arguments: run with the real values, the answers made safe with the same placeholders."""
    mail = F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("session"), F.col("c_custkey").alias("doc"), F.lit('{"to":"<<EMAIL_1>>","file":"src/a.py"}').alias("json"), mail.alias("mail"))
    kinds = {"entity_type": "EMAIL", "token": "<<EMAIL_1>>", "rule_id": "email", "label": "Email Address", "category": "PII", "severity": "low"}
    known = rows.select("session", F.col("mail").alias("value"), *(F.lit(v).alias(k) for k, v in kinds.items()))
    run = lambda calls: calls.withColumn("result", F.concat(F.lit('{"sent":"to '), F.get_json_object("json", "$.to"), F.lit(' and d'), F.col("doc"), F.lit('@example.com"}')))
    done = json_mask.tool_round_trip(rows.select("session", "doc", "json"), known, "session", ["session", "doc"], run)[0]
    return done.select("doc", F.col("redacted").alias("answer"), json_mask.tool_language_column(F.col("json")).alias("language"))


def history_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations made safe again: those of even ids have issued a placeholder before, the others are scanned."""
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "concat('write to a', CAST(turn % 2 AS STRING), '@example.com or a1@example.com') AS text")
    kinds = {"value": "a1@example.com", "entity_type": "EMAIL", "token": "<<EMAIL_7>>", "rule_id": "email", "label": "Email Address", "category": "PII", "severity": "low"}
    issued = turns.where("conv_id % 2 = 0").select("conv_id").distinct().select("conv_id", *(F.lit(v).alias(k) for k, v in kinds.items()))
    return conversation.redact_history(turns, issued)[0].select("conv_id", "turn", "redacted")


def semantic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values beside words that are near a seed, where nothing else is found."""
    text = F.concat(F.lit("the passcode maybe Zx"), F.col("s_suppkey"), F.lit("qwert99 today"))
    found = findings(detect(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), config=ScanConfig(semantic=True)), "s_suppkey", with_values=True)
    return found.select("s_suppkey", "rule_id", "severity", F.col("start").cast("long").alias("start_at"), "value")


def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy merging of the spans that an order's lines stand for: place by quantity, length by line, layer by flag."""
    rows = table(spark, sf_dir, "lineitem")
    start = F.col("l_quantity").cast("int")
    one = span(F.col("l_returnflag"), F.lit(""), F.lit("low"), F.lit("PII"), F.col("l_linenumber").cast("string"), start, start + F.col("l_linenumber") + 2)
    grouped = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", one.alias("s"), (F.col("l_returnflag") != "R").alias("layer")))).alias("x"))
    pick = lambda layer: F.transform(F.filter("x", lambda r: r["layer"] == layer), lambda r: r["s"])
    kept = grouped.select("l_orderkey", F.explode(merge(pick(False), pick(True))).alias("s"))
    return kept.select("l_orderkey", F.col("s.value").cast("int").alias("l_linenumber"), F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural findings by category and severity, with sums."""
    found = notes(spark, sf_dir).select(F.explode(structural_spans(F.col("text"), tuple(RULES[r] for r in ("email", "pan-india", "ssn-us", "jwt", "aws-access-key", "slack-token")))).alias("s"))
    return found.rollup("s.category", "s.severity").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


def anonymized(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spans = structural_spans(F.col("text"), (RULES["email"],))
        return notes(spark, sf_dir).select("note_id", redact.anonymize(F.col("text"), spans, mode).alias("hidden"))

    return query


def _with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).withColumn("spans", merge(structural_spans(F.col("text"), (RULES["email"], RULES["pan-india"], RULES["jwt"])), F.array().cast(SPANS)))


def _redacted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(notes with redacted, mappings of their sessions); texts are scanned once."""
    found = materialize(_with_spans(spark, sf_dir), "spans")
    mappings = materialize(redact.mint(redact.typed(found, "session_id", "note_id"), "session_id", "note_id"), "mappings")
    return redact.redact(found, mappings, "session_id", ["session_id", "note_id"]), mappings


def mint_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of each session, numbered by first appearance."""
    return redact.mint(redact.typed(_with_spans(spark, sf_dir), "session_id", "note_id"), "session_id", "note_id").select("session_id", "entity_type", "value", "token")


def redact_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir)[0].select("note_id", "redacted")


def redact_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come back unchanged from redacting and restoring."""
    hidden, mappings = _redacted(spark, sf_dir)
    return redact.restore_rows(hidden, mappings, "session_id", ["note_id"], "redacted").select("note_id", F.col("restored").alias("text"))


_PAIRS = (("<<PERSON_1>>", "server"), ("<<PERSON_2>>", "the server"), ("<<PORT_1>>", "on"), ("<<EMAIL_1>>", "user7@example.com"))


def _pairs():
    return F.array(*(F.struct(F.lit(t).alias("token"), F.lit(v).alias("value")) for t, v in _PAIRS))


def known_value_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note_id", redact.redact_known(F.col("text"), _pairs()).alias("redacted"))


_ANSWER = "concat('see <<PERSON_1>> and << person_2 >> at <<port_1>> or <<EMAIL_', CAST(note_id % 3 AS STRING), '>> and <<EMAIL_', CAST(note_id % 3 AS STRING), '>>')"


def restore_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note_id", redact.restore(F.expr(_ANSWER), _pairs()).alias("text"))


def unrestored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = redact.unrestored(redact.restore(F.expr(_ANSWER), _pairs()), F.array(F.lit("EMAIL")))
    return notes(spark, sf_dir).select("note_id", F.explode(left).alias("token"))


_TURNS = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'the password is' WHEN 1 THEN concat('use hunter', CAST(conv_id AS STRING), 'isnotsecure now') WHEN 2 THEN 'rotate the access token' ELSE 'carry on as before' END"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations").select("conv_id", "turn")).selectExpr("conv_id", "turn", f"{_TURNS} AS text")


def carry_over_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that answer a credential asked for up to two turns before."""
    found = conversation.detect_conversations(_turns(spark, sf_dir))
    return found.select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", F.col("s.rule_id").alias("rule_id"), F.col("s.label").alias("label"), F.col("s.value").alias("value"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the notes' hashing vectors that aren't zero."""
    own = notes(spark, sf_dir).select("note_id", F.posexplode(embedding.embed(F.col("text"))).alias("bucket", "x")).where("x <> 0")
    return own.select("note_id", F.col("bucket").cast("long").alias("bucket"), F.round("x", 6).alias("weight"))


def centroid_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the package's example sentences."""
    rows = [(c, e) for c, es in (embedding.load_data("category_examples.json") or {}).items() for e in es]
    built = embedding.centroids(spark.createDataFrame(rows, "category string, example string"))
    return built.select("category", F.posexplode("vector").alias("bucket", "x")).where("x <> 0").select("category", F.col("bucket").cast("long").alias("bucket"), F.round("x", 6).alias("weight"))


def routing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the notes in each category."""
    own = notes(spark, sf_dir).select("note_id", F.explode(embedding.scores(embedding.embed(F.col("text")))).alias("s"))
    return own.select("note_id", F.col("s.category").alias("category"), F.round("s.score", 6).alias("score"))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label whose mean vector is nearest to each vector of embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    known = embedding.centroids(rows.select(F.col("label").cast("string").alias("category"), F.col("embedding").alias("v")), F.col("v"))
    label = known.select(F.col("category").cast("long").alias("category"), "vector").orderBy("category")
    found = embedding.nearest(rows.select("vec_id", "embedding"), "embedding", label, ["category"], digits=6)
    return found.select("vec_id", F.col("__at.category").alias("category"), F.col("__at.score").alias("score"))


def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions over orders whose lines stand for spans: severity by quantity, business by tax."""
    rows = table(spark, sf_dir, "lineitem")
    severity = F.when(F.col("l_quantity") > 48, "high").when(F.col("l_quantity") > 20, "medium").otherwise("low")
    one = span(F.col("l_returnflag"), F.concat(F.lit("Label "), F.col("l_returnflag")), severity, F.lit("PII"), F.lit("v"), F.col("l_linenumber"), F.col("l_linenumber") + 1)
    lists = rows.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_discount") > 0.02, one)).alias("s"), F.collect_list(F.when(F.col("l_tax") >= 0.08, one)).alias("b"))
    return lists.select("l_orderkey", policy.decide(F.col("s"), F.slice("b", 1, 1), block_high=True)["action"].alias("action"), F.coalesce(policy.highest(F.col("s")), F.lit(-1)).alias("highest"))


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit details of the notes, without values."""
    found = _with_spans(spark, sf_dir).select("note_id", F.explode(policy.audit_details(F.col("spans"))).alias("d"))
    return found.select("note_id", "d.rule_id", "d.entity_type", "d.severity", F.col("d.value").isNull().alias("hidden"))


def select_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.concat_ws("_", F.col("p_name"), F.col("p_brand")).alias("name"))
    return selection.select_tools(parts, 128.9, ["cold*", "*_brand#1?", "SMALL widget_Brand#5"]).select("position", "status")


_ERRORS = "CASE n_nationkey % 4 WHEN 0 THEN concat('You may not send more than ', CAST(n_nationkey + 1 AS STRING), ' tools') WHEN 1 THEN concat('a maximum of ', CAST(n_nationkey AS STRING), ' tool is allowed') WHEN 2 THEN 'more than 5 items' ELSE 'no tool here' END"


def tool_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(selection.limit_from_error(F.expr(_ERRORS)), F.lit(-1).cast("long")).alias("most"))


_SETTINGS = (("routingMinSimilarity", "NaN"), ("routingMinSimilarity", "0.3"), ("maxTools", '"5"'), ("maxTools", "12"), ("enablePiiDetection", "1"), ("enablePiiDetection", "false"), ("toolDenyList", '["a*", "b"]'), ("toolDenyList", '["a", 1]'), ("embeddingApiUrl", '"http://x"'), ("embeddingApiUrl", "null"))


def settings_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.resolve(spark.createDataFrame(list(_SETTINGS), "key string, raw string"))


def json_mask_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and fields with sensitive names, by schema."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("user_name"), F.struct(F.col("c_mktsegment").alias("host"), F.col("c_nationkey").alias("port"), F.array("c_name", F.lit("")).alias("e-mail")).alias("info"))
    masked = json_mask.mask_columns(rows)
    return masked.select("c_custkey", "user_name", F.col("info.host").alias("host"), F.col("info.port").alias("port"), F.array_join(F.col("info.e-mail"), "|").alias("mails"))


def json_mask_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts of customers, masked by field and by content."""
    text = F.to_json(F.struct(F.struct(F.col("c_name").alias("username"), F.concat(F.lit("write to "), F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("notes")).alias("who"), F.col("c_acctbal").alias("balance")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("session"), F.col("c_custkey").alias("doc"), text.alias("json"))
    return json_mask.redact_json(rows, "session", ["session", "doc"])[0].select("doc", "redacted")


def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.rule_id, r.category) for r in RULES.values()] + [("proximity-" + p.replace(" ", "-"), "SECRET") for p, _, _ in fixed.PHRASES]
    rows += [(r, "INFRA") for r in "private-ip-standalone public-ip-standalone internal-url external-url unix-file-path windows-file-path mac-address ipv6-standalone ipv6-link-local internal-hostname port-contextual semantic-infrastructure".split()]
    df = spark.createDataFrame(rows, "rule_id string, category string")
    return df.select("rule_id", entity_type_column(F.col("rule_id"), F.col("category")).alias("entity_type"))


QUERIES: dict[str, Query] = {f"structural_{r.replace('-', '_')}": structural(r) for r in RULES} | {
    "plain_tokens": tokens(PLAIN),
    "proximity_tokens": tokens(PROXIMITY),
    "mask_hash": anonymized("hash"),
    "mask_stars": anonymized("mask"),
} | {
    f.__name__: f
    for f in (
        document_spans, detect_notes, detect_documents, detect_lines, page_urls, line_split, number_context, port_context, person_names, detect_places, phrase_spans, highlight_spans, anonymize_ranges, udf_scan, udf_redact, tool_calls, history_replay, semantic_values, merge_spans, severity_rollup, mint_tokens, redact_placeholder, redact_restore,
        known_value_redact, restore_answer, unrestored_tokens, carry_over_spans, hash_embedding, centroid_build, routing_scores, nearest_centroid, policy_decision, audit_trail, select_tools, tool_limits, settings_resolve,
        json_mask_static, json_mask_dynamic, entity_types,
    )
}
