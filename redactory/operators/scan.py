"""Detection over a table: all detectors in one Arrow stage, which a text passes once. Nothing is shuffled."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions import lexicon as fixed
from redactory.functions.arrays import batched, lists
from redactory.functions.comments import comment_ranges, language_of
from redactory.functions.tokens import line_pieces
from redactory.operators.contextual import Words, carried_over, contextual_spans, national_ids
from redactory.operators.embedding import Centroids, built_in_centroids, business_spans, embed, gates, nearest_seed, ranked, scores, semantic_spans, vector_of
from redactory.operators.infra import Ranges, infra_spans
from redactory.operators.spans import SPANS, Found, merge, merged, no_spans, outside_comments, span_lists, without_rules
from redactory.operators.structural import PII_RULES, SECRET_RULES, Rule, spans_in


@dataclass(frozen=True)
class ScanConfig:
    """What is looked for. Thresholds are numbers; see redactory.sources.settings for settings of unknown origin."""

    pii: bool = True
    infra: bool = True
    secrets: bool = True
    person_names: bool = False
    by_line: bool = False
    """Context detectors look at each line by itself."""
    routed: bool = False
    """Context detectors run where the text's category scores enough."""
    route_min: float = fixed.ROUTE_MIN
    business: bool = False
    """The business flag; needs an embedder that tells whole messages apart (see vector_col)."""
    business_min: float = fixed.BUSINESS_MIN
    vector_col: str | None = None
    """A column with the texts' vectors; by default the hashing embedder's."""
    language_col: str | None = None
    """A column with a language or file name: comments of source text are then let through, credentials of fixed form excepted."""
    carry_cols: tuple[str, str] | None = None
    """Columns with the rule id and label of a credential that an earlier turn asked for."""
    centroids: Centroids = ()
    """Centroids of one's own (see redactory.sources.files.read_centroids); the package's, if there are none."""
    disabled: tuple[str, ...] = field(default_factory=tuple)
    rules: tuple[Rule, ...] = field(default_factory=tuple)
    """Rules of one's own, beside those of fixed form."""
    semantic: bool = False
    """Words that are near a seed find values around them, where nothing else was found. By the built-in embedder, or nearest_col."""
    semantic_min: float = fixed.SEMANTIC_MIN
    nearest_col: str | None = None
    """A column with the near words of each text by another embedder (see redactory.operators.embedding.nearest_words)."""


_GATES = {"pii": "pii", "infra": "infrastructure", "secrets": "credentials"}
_SEEN = "array<struct<rule_id:string,label:string>>"


def _moved(found: list[Found], by: int) -> list[Found]:
    return [(*x[:5], x[5] + by, x[6] + by) for x in found] if by else found


def scan_words(text: str, config: ScanConfig, on: dict[str, bool], carry: tuple[str, str] | None = None) -> tuple[list[Found], list[Found], list[tuple[str, str]]]:
    """Structural spans beyond rules of fixed form, contextual spans, and the credential keywords seen."""
    structural = national_ids(Words(text)) if config.pii and any(k in text.lower() for k in ("aadh", "uid")) else []
    if config.infra:
        structural += infra_spans(text)
    context, seen = [], []
    known = (config.centroids or built_in_centroids()) if config.routed and config.by_line else ()
    for piece, at in line_pieces(text) if config.by_line else [(text, 0)]:
        if known:  # each line is routed by itself
            on = routed(piece, config)
        own, words = contextual_spans(piece, pii=config.pii and on["pii"], infra=config.infra and on["infra"], secrets=config.secrets and on["secrets"], names=config.person_names)
        context += _moved(own, at)
        seen += words
    if carry:
        context += carried_over(text, *carry)
    return structural, context, seen


def routed(text: str, config: ScanConfig) -> dict[str, bool]:
    """Which context detectors a text is routed to by the built-in embedder; all, if centroids are missing."""
    known = config.centroids or built_in_centroids()
    best = dict(ranked(vector_of(text, len(known[0][1]))[None], known)[0]) if known else {}
    return {k: not known or best.get(c, 0.0) >= config.route_min for k, c in _GATES.items()}


@dataclass
class Scanned:
    structural: list[Found]
    context: list[Found]
    late: list[Found]
    seen: list[tuple[str, str]]
    comments: list[tuple[int, int]]

    def spans(self, config: ScanConfig) -> list[Found]:
        """merge(), then what is off or in comments goes."""
        out = merged(self.structural, self.context, self.late)
        if config.disabled:
            out = [s for s in out if s[0] not in config.disabled]
        if self.comments and config.language_col:
            inside = Ranges(self.comments)
            out = [s for s in out if s[0] in fixed.COMMENT_RULES or not inside.hold(s[5], s[6])]
        return out


def scan_text(text: str, config: ScanConfig, *, on: dict[str, bool] | None = None, language: str | None = None, carry: tuple[str, str] | None = None, nearest: dict | None = None) -> Scanned:
    """What all detectors find in one text. on: which context detectors run, if that is known."""
    if on is None:
        on = routed(text, config) if config.routed and not config.by_line else dict.fromkeys(_GATES, True)
    more, context, seen = scan_words(text, config, on, carry)
    structural = spans_in(text, (*SECRET_RULES, *(PII_RULES if config.pii else ()), *config.rules)) + more
    late = []
    if config.semantic:
        taken = [(s[5], s[6]) for s in merged(structural, context)]
        late = semantic_spans(text, taken, nearest_seed if config.nearest_col is None else nearest or {}, config.semantic_min)
    return Scanned(structural, context, late, seen, comment_ranges(text, language_of(language)) if language else [])


def _stage(config: ScanConfig, names: tuple[str, ...], whole: bool, *arrays: pa.Array) -> pa.Array:
    """struct<spans, seen> if whole, else what parts() has before merging."""
    rows = dict(zip(names, (a.to_pylist() for a in arrays), strict=True))
    out = []
    for i, text in enumerate(rows["text"]):
        get = lambda n: rows[n][i] if n in rows else None  # noqa: E731, B023
        on = {k: get(f"on_{k}") for k in _GATES} if "on_pii" in rows else None
        near = {x["word"]: tuple(x[k] for k in ("group", "label", "category", "severity", "score")) for x in get("nearest") or []}
        out.append(scan_text(text, config, on=on, language=get("lang"), carry=(get("rule"), get("label")) if get("rule") else None, nearest=near))
    seen = lists([x.seen for x in out], ("rule_id", "label"), (pa.string(), pa.string()))
    if whole:
        return pa.StructArray.from_arrays([span_lists([x.spans(config) for x in out]), seen], names=["spans", "seen"])
    found = [span_lists([getattr(x, n) for x in out]) for n in ("structural", "context", "late")]
    comments = lists([x.comments for x in out], ("start", "end"), (pa.int32(), pa.int32()))
    return pa.StructArray.from_arrays([*found, seen, comments], names=["structural", "context", "late", "seen", "comments"])


def _scan(df: DataFrame, text_col: str, config: ScanConfig, whole: bool) -> tuple[DataFrame, Column]:
    """df with __found (see _stage), and the texts' scores by category."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.lit(None).cast("array<struct<category:string,score:double>>")
    if config.business or config.routed and config.vector_col and not config.by_line:
        own = scores(F.col(config.vector_col) if config.vector_col else embed(text), config.centroids or None)
    inputs = {"text": text}
    if config.routed and config.vector_col and not config.by_line:
        inputs |= {f"on_{k}": v for k, v in gates(own, config.route_min).items()}
    if config.language_col:
        inputs["lang"] = F.col(config.language_col)
    if config.carry_cols:
        inputs |= {"rule": F.col(config.carry_cols[0]), "label": F.col(config.carry_cols[1])}
    if config.nearest_col:
        inputs["nearest"] = F.col(config.nearest_col)
    kind = f"struct<spans:{SPANS},seen:{_SEEN}>" if whole else f"struct<structural:{SPANS},context:{SPANS},late:{SPANS},seen:{_SEEN},comments:array<struct<start:int,end:int>>>"
    return df.withColumn("__found", batched(partial(_stage, config, tuple(inputs), whole), kind, *inputs.values())), own


def parts(df: DataFrame, text_col: str = "text", config: ScanConfig | None = None) -> DataFrame:
    """df with what detection finds before merging: __structural, __context, __late, __comments, __ranked, keywords_seen. Nothing is shuffled."""
    config = config or ScanConfig()
    out, own = _scan(df, text_col, config, False)
    found = {f"__{n}": F.col(f"__found.{n}") for n in ("structural", "context", "late", "comments")}
    return out.select(*df.columns, *(v.alias(k) for k, v in found.items()), own.alias("__ranked"), F.col("__found.seen").alias("keywords_seen"))


def finish(found: DataFrame, text_col: str = "text", config: ScanConfig | None = None) -> DataFrame:
    """The columns of parts(), merged: spans, business, keywords_seen."""
    config = config or ScanConfig()
    spans = without_rules(merge(F.col("__structural"), F.col("__context"), F.col("__late")), list(config.disabled))
    if config.language_col:
        spans = outside_comments(spans, F.col("__comments"))
    business = business_spans(F.coalesce(F.col(text_col), F.lit("")), F.col("__ranked"), config.business_min) if config.business else no_spans()
    names = [c for c in found.columns if c not in ("__structural", "__context", "__late", "__comments", "__ranked", "keywords_seen")]
    return found.select(*names, spans.alias("spans"), business.alias("business"), "keywords_seen")


def detect(df: DataFrame, text_col: str = "text", config: ScanConfig | None = None) -> DataFrame:
    """df with spans (merged, disjoint, in order), business (none or one span) and keywords_seen. Nothing is shuffled.

    Null texts have no spans. With by_line and routed together each line is routed by itself.
    """
    config = config or ScanConfig()
    out, own = _scan(df, text_col, config, True)
    business = business_spans(F.coalesce(F.col(text_col), F.lit("")), own, config.business_min) if config.business else no_spans()
    return out.select(*df.columns, F.col("__found.spans").alias("spans"), business.alias("business"), F.col("__found.seen").alias("keywords_seen"))


def findings(detected: DataFrame, *keys: str, with_values: bool = False) -> DataFrame:
    """A row for each span. Values are left out unless they are asked for: the table would hold what was to be hidden."""
    rows = detected.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.*")
    return rows if with_values else rows.drop("value")


#: The quick profile of editors: everything by fixed form or by words on one line, nothing by embeddings.
OFFLINE = ScanConfig(by_line=True)
