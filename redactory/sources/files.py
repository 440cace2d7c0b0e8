"""Texts, mappings and the audit trail as files."""

from __future__ import annotations

import json
import logging

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.operators.embedding import Centroids

MAPPING = "session string, token string, entity_type string, value string, category string, severity string, rule_id string, label string"
log = logging.getLogger(__name__)


def read_texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path and text of whole files; pattern is a glob over names."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def grep(texts: DataFrame, pattern: str) -> DataFrame:
    """path, line_no, line of the lines that match a pattern."""
    rows = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    return rows.where(F.col("line").rlike(pattern)).select("path", (F.col("i") + 1).alias("line_no"), "line")


def edit(texts: DataFrame, old: str, new: str) -> DataFrame:
    """texts with one place changed. A text where the old part stands more than once has an error instead."""
    n = F.size(F.split("text", f"\\Q{old}\\E", -1)) - 1
    return texts.select("path", F.when(n == 1, F.replace("text", F.lit(old), F.lit(new))).otherwise(F.col("text")).alias("text"), F.when(n > 1, F.lit("old text is not unique")).when(n < 1, F.lit("old text not found")).alias("error"))


def read_json(spark: SparkSession, path: str) -> object | None:
    """The content of one JSON file, or None if it is missing or isn't JSON: what needs it is then off."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (PySparkException, Py4JError, ValueError, TypeError):
        log.warning("%s could not be read", path, exc_info=True)
        return None


def _is_vector(x: object) -> bool:
    return isinstance(x, list) and bool(x) and all(isinstance(v, int | float) and not isinstance(v, bool) for v in x)


def read_centroids(spark: SparkSession, path: str) -> Centroids | None:
    """Centroids of one's own, an object of a vector for each category, for ScanConfig.centroids. None unless all are vectors of one length."""
    found = read_json(spark, path)
    if not isinstance(found, dict) or not found or not all(map(_is_vector, found.values())) or len({len(v) for v in found.values()}) != 1:
        return None
    return tuple((k, tuple(map(float, v))) for k, v in found.items())


def read_examples(spark: SparkSession, path: str) -> DataFrame | None:
    """category, example of a file of example sentences (an object of lists), for embedding.centroids(); None if it has another form."""
    found = read_json(spark, path)
    if not isinstance(found, dict) or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in found.values()):
        return None
    return spark.createDataFrame([(k, x) for k, v in found.items() for x in v], "category string, example string")


def read_seeds(spark: SparkSession, path: str) -> DataFrame | None:
    """group, label, category, severity, seed of a file of seeds, as embedding.seed_table() has them; None if it has another form."""
    found = read_json(spark, path)
    try:
        rows = [(g, str(x["label"]), str(x["category"]), str(x["severity"]), str(s)) for g, x in found.items() for s in x["seeds"]]
    except (AttributeError, KeyError, TypeError):
        return None
    return spark.createDataFrame(rows, "group string, label string, category string, severity string, seed string")


def save_mappings(mappings: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rewrites the mappings of sessions. They hold the real values: saving them is a choice of the caller."""
    mappings.write.mode("overwrite").format(kind).save(path)


def load_mappings(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(MAPPING).format(kind).load(path)


def append_audit(entries: DataFrame, path: str) -> bool:
    """Appends audit entries as JSON lines. A failure is logged and doesn't stop what is audited."""
    try:
        entries.write.mode("append").json(path)
    except Exception:
        log.warning("audit entries could not be written to %s", path, exc_info=True)
        return False
    return True


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    detail = "struct<rule_id:string,label:string,severity:string,category:string,entity_type:string,token:string,value:string>"
    return spark.read.schema(f"timestamp string, source string, action string, reason string, details array<{detail}>").json(path)
