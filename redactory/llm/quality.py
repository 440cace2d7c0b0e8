"""Quality rules with host-level verdicts, in DataFrame operations only.

Each document is measured by itself (`measures`): words `[^\\x20\\x09-\\x0D]+`, their code points, symbols, repeated lines and words in
repeated three-word windows (windows are told apart by a 64-bit hash of their words). A document breaks a hard rule if it is short or repetitive (base_failed), and a soft rule if it has many
symbols or mostly repeated lines. Failures are summed by host; the hosts' rates get a beta prior by the method of moments over all
hosts, and each host's rate is shrunk to it. The verdict on a host is joined back to its documents:

- a host whose shrunk rate is at least `reject_rate` loses all its documents;
- a host whose shrunk rate is below `trust_rate` is trusted, and only hard rules count there;
- elsewhere a document that breaks any rule is not kept.

Measures are written once to the shared folder, since the hosts' sums and the documents both need them. Sums by host are partial before
they are shuffled; the join back is on the host, which Spark splits if a host is hot and the hosts are too many to broadcast.

Defined cases: a null or empty text has no words and fails (fewer than `min_words`); a null host is a host of its own; an empty table
gives no rows; repeated rows are judged alike and count each in their host's rate; ties at a threshold count as reached; columns of other
names are kept by filter_quality, clashing names included, and ignored by verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.session import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RULES = {"min_words": 50, "repeat_percent": 50, "symbol_percent": 20, "line_percent": 60, "reject_rate": 0.95, "trust_rate": 0.01}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__lines")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of MEASURES. Every step is one projection, so each array is made once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = docs.withColumns({"__w": words_of(text), "__l": lines, "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")})
    three = F.transform(F.sequence(F.lit(1), F.size("__w") - 2), lambda i: F.xxhash64(F.get("__w", i - 1), F.get("__w", i), F.get("__w", i + 1)))
    out = out.withColumns({"n_words": F.size("__w").cast("long"), "__lines": F.size("__l").cast("long"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"), "__g": F.when(F.size("__w") >= 4, three).otherwise(F.array().cast("array<long>"))}).drop("__w", "__l")
    # windows in order of their hash: equal ones are neighbours. Their places, in order, cover the repeated words.
    ordered = F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.array_sort(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    out = out.withColumn("__s", ordered).drop("__g")
    again = F.filter("__s", lambda x, i: (F.coalesce(F.get("__s", i - 1)["g"] == x["g"], F.lit(False))) | (F.coalesce(F.get("__s", i + 1)["g"] == x["g"], F.lit(False))))
    out = out.withColumn("__p", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("__s")
    covered = F.aggregate("__p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__p")


def judged(measured: DataFrame, rules: dict) -> DataFrame:
    """measured with base_failed and __soft."""
    n = F.col("n_words")
    hard = (n < rules["min_words"]) | (100 * F.col("n_repeat_words") > rules["repeat_percent"] * n)
    soft = (100 * F.col("n_symbols") >= rules["symbol_percent"] * n) & (F.col("n_symbols") > 0) | (100 * F.col("n_dup_lines") >= rules["line_percent"] * F.col("__lines")) & (F.col("n_dup_lines") > 0)
    return measured.withColumns({"base_failed": hard, "__soft": soft})


def host_rates(judged_docs: DataFrame, host_col: str) -> DataFrame:
    """host, n_docs, n_failed, rate: failures by host, shrunk by a beta prior.

    With p the mean rate over documents and v the variance of the hosts' rates about it, weighted by documents, less what counting
    alone gives, the prior has strength p (1 - p) / v - 1 (no less than 1; as large as 1e6 where hosts don't differ).
    """
    hosts = judged_docs.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("base_failed") | F.col("__soft")).cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "hosts", hosts.count())
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("h"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q")).first()  # one row
    if not total.n:
        return hosts.withColumn("rate", F.lit(0.0))
    p = total.f / total.n
    between = total.q / total.n - p * p - p * (1 - p) * (total.h - 1) / total.n
    strength = min(1e6, max(1.0, p * (1 - p) / between - 1)) if between > 0 else 1e6
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(p * strength)) / (F.col("n_docs") + F.lit(float(strength))))


def verdicts(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None, **rules) -> DataFrame:
    """Columns `keep` of docs (all, if None) with MEASURES, base_failed, host_rate and kept."""
    rules = RULES | rules
    own = docs if keep is None else docs.select(*dict.fromkeys([*keep, text_col, host_col]))
    clash = [c for c in own.columns if c in {*MEASURES, "base_failed", "host_rate", "kept"}]
    measured = measures(own.withColumnsRenamed({c: f"__in_{c}" for c in clash}), f"__in_{text_col}" if text_col in clash else text_col)
    host = f"__in_{host_col}" if host_col in clash else host_col
    if keep is not None and text_col not in keep:
        measured = measured.drop(text_col)
    known = materialize(judged(measured, rules), "measures")
    rates = host_rates(known, host).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"))
    out = known.join(rates, known[host].eqNullSafe(rates["__host"]), "left").drop("__host")
    kept = ~F.col("base_failed") & (F.col("host_rate") < rules["reject_rate"]) & (~F.col("__soft") | (F.col("host_rate") < rules["trust_rate"]))
    return out.withColumn("kept", kept)


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rules) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    return verdicts(own, keep=["doc_id", "source"], **rules).select("doc_id", *MEASURES[:-1], "base_failed", "host_rate", "kept")


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """docs without those that are not kept."""
    names = docs.columns
    out = verdicts(docs, **options).where("kept")
    clash = {*MEASURES, "base_failed", "host_rate", "kept"}
    return out.select(*(F.col(f"__in_{c}" if c in clash else c).alias(c) for c in names))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n >= 2),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(l) AS lines
  FROM d LEFT JOIN covered USING (doc_id)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (100 * n_symbols >= 20 * n_words AND n_symbols > 0) OR (100 * n_dup_lines >= 60 * lines AND n_dup_lines > 0) AS soft
  FROM m
), h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR soft THEN 1.0::DOUBLE ELSE 0 END) AS f FROM j GROUP BY 1),
s AS (SELECT sum(n) AS n, sum(f) / sum(n) AS p, count(*) AS h, sum(f * f / n) / sum(n) AS q FROM h),
v AS (SELECT n, p, q - p * p - p * (1 - p) * (h - 1) / n AS b FROM s),
k AS (SELECT p, CASE WHEN b > 0 THEN least(1e6, greatest(1.0, p * (1 - p) / b - 1)) ELSE 1e6 END AS a FROM v),
r AS (SELECT source, (f + p * a) / (n + a) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS host_rate,
  NOT base_failed AND rate < 0.95 AND (NOT soft OR rate < 0.01) AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""
