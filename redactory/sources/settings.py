"""Settings of unknown origin, key by key: what has the wrong type falls back to the default, so detection keeps working."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions.lexicon import BUSINESS_MIN, CARRY_TURNS, ROUTE_MIN, SEMANTIC_MIN
from redactory.operators.scan import ScanConfig

# Keys and defaults.
DEFAULTS = {
    "blockOnHighSeverity": False, "blockOnBusinessContent": True,
    "enablePiiDetection": True, "enableInfraDetection": True, "enableConversationalSecretDetection": True, "enableCrossTurnSecretCarryover": True, "crossTurnSecretTurns": CARRY_TURNS,
    "enableHeuristicNameDetection": False, "enableBusinessContentDetection": True, "enableSemanticKeywordMatching": True, "enableSyntaxAwareRedaction": True,
    "routingMinSimilarity": ROUTE_MIN, "businessContentThreshold": BUSINESS_MIN, "semanticMatchThreshold": SEMANTIC_MIN, "alwaysRunAllDetectors": False,
    "embeddingBackend": "api", "autoStartEmbeddingServer": True, "embeddingServerNodePath": "", "embeddingApiUrl": "http://localhost:9000", "embeddingApiTimeoutMs": 3000, "embeddingApiModel": "",
    "embeddingApiAuthType": "none", "embeddingApiAuthToken": "", "embeddingApiKeyHeader": "x-api-key", "embeddingApiFormat": "native", "embeddingApiEmbedPath": "", "embeddingApiHealthPath": "/health",
    "embeddingApiRequestField": "texts", "embeddingApiResponsePath": "embeddings", "trustCustomEmbeddingsForBlocking": False,
    "disabledSecretRules": [], "disabledPiiRules": [], "disabledInfraRules": [], "disabledConversationalSecretRules": [], "disabledSemanticRules": [],
    "auditLogIncludeValues": False, "persistSessionMappings": False, "enableToolCalling": True, "maxTools": 128, "toolDenyList": [], "maxToolRounds": 25,
}


def fits(value: object, default: object) -> bool:
    if isinstance(default, bool) or isinstance(value, bool):
        return isinstance(default, bool) and isinstance(value, bool)
    if isinstance(default, list):
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    if isinstance(default, str):
        return isinstance(value, str)
    return isinstance(value, int | float) and math.isfinite(value)


def sanitize(raw: dict) -> tuple[dict, list[str]]:
    """(settings with every key, keys that were rejected). A key that is absent isn't rejected."""
    bad = [k for k, d in DEFAULTS.items() if k in raw and not fits(raw[k], d)]
    return {k: raw[k] if k in raw and k not in bad else d for k, d in DEFAULTS.items()}, bad


def read_settings(path: str) -> tuple[dict, list[str]]:
    """The settings of a JSON file; the defaults if it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError):
        raw = {}
    return sanitize(raw if isinstance(raw, dict) else {})


def scan_config(settings: dict, **more) -> ScanConfig:
    """The scan that settings ask for, with more fields of ScanConfig.

    Routing, the business flag and semantic keywords need an embedder that can tell meanings apart: they are on where settings ask for
    them and more gives its vectors (vector_col) or near words (nearest_col). A language column counts if syntax is to be heeded. Where
    all detectors are to run always, nothing is routed and no business flag is raised.
    """
    s, given = settings, lambda k: more.get(k) is not None
    always = s["alwaysRunAllDetectors"]
    off = tuple(x for k in DEFAULTS if k.startswith("disabled") for x in s[k])
    names = {
        "pii": s["enablePiiDetection"], "infra": s["enableInfraDetection"], "secrets": s["enableConversationalSecretDetection"], "person_names": s["enableHeuristicNameDetection"],
        "route_min": s["routingMinSimilarity"], "business_min": s["businessContentThreshold"], "semantic_min": s["semanticMatchThreshold"], "disabled": off,
        "routed": given("vector_col") and not always, "business": s["enableBusinessContentDetection"] and given("vector_col") and not always, "semantic": s["enableSemanticKeywordMatching"] and given("nearest_col"),
    }
    if not s["enableSyntaxAwareRedaction"]:
        more = more | {"language_col": None}
    return ScanConfig(**names | more)


def carry_turns(settings: dict) -> int:
    """For how many turns a credential that was asked for is expected; 0 if it isn't carried over."""
    return int(settings["crossTurnSecretTurns"]) if settings["enableCrossTurnSecretCarryover"] else 0


def resolve(rows: DataFrame, key: str = "key", raw: str = "raw") -> DataFrame:
    """rows (key, raw JSON text) with rejected and resolved (JSON text), for tables of settings."""
    spark: SparkSession = rows.sparkSession
    table = spark.createDataFrame([(k, json.dumps(v), "list" if isinstance(v, list) else "bool" if isinstance(v, bool) else "str" if isinstance(v, str) else "num") for k, v in DEFAULTS.items()], "key string, fallback string, kind string")
    own = F.trim(F.col(raw))
    ok = (
        F.when(F.col("kind") == "bool", own.isin("true", "false"))
        .when(F.col("kind") == "str", own.rlike(r'^"(?:[^"\\]|\\.)*"$'))
        .when(F.col("kind") == "num", own.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"))
        .otherwise(own.rlike(r'^\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$'))
    )
    joined = rows.join(F.broadcast(table), rows[key] == table["key"]).select(*(rows[c] for c in rows.columns), "fallback", ok.alias("__ok"))
    return joined.select(*rows.columns, (~F.col("__ok")).alias("rejected"), F.when(F.col("__ok"), own).otherwise(F.col("fallback")).alias("resolved"))
