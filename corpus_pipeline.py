"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, source mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.decontam import drop_contaminated
from redactory.llm.mixture import mixture_rows
from redactory.llm.quality import filter_quality
from redactory.llm.queries import table, vocabulary
from redactory.llm.simhash import near_dedup
from redactory.llm.token_files import id_counts, token_files
from redactory.session import forget, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep."""
    return filter_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least doc_id: shingles of five words, an exact Jaccard similarity of 0.8 or more."""
    return near_dedup(docs, width=5, alike=0.6, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights select them, counted in the ids that the token files will hold."""
    return mixture_rows(docs, tokens=id_counts(spark, F.col("text"), vocabulary()))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files(spark, docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixture", source_mixture),
    ("token files", token_output),
]

#: Tokenization isn't expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)  # the next stage reads only what this one wrote
    return STAGES[-1][1](spark, docs, sf_dir)
