"""Queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from redactory.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; a small one is dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.mixture import mix_documents

    mixed = mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.selectExpr("doc_id", "__domain AS domain", "lang", "source", "__tokens AS n_tokens", "__copies AS copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.token_files import token_files

    return token_files(spark, table(spark, sf_dir, "documents"), vocabulary())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.pii_crf import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.langid import identify, learn
    from redactory.llm.split import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(fold("doc_id", 4) != 2).select("text", "lang"))
    return identify(docs.withColumn("held_out", fold("doc_id", 4) == 2).select("doc_id", "held_out", "text"), model)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from redactory.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.kneser_ney import count_model, score
    from redactory.llm.split import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = count_model(docs.where(fold("doc_id", 5) != 1))
    return score(docs.withColumn("held_out", fold("doc_id", 5) == 1).select("doc_id", "held_out", "text"), model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_mixture, op3_simhash, op4_token_files, op5_html_text, op6_decontamination, op7_personal_data, op8_quality_rules, op9_language, op10_language_model)}


def oracle_sql() -> dict[str, str]:
    from redactory.llm import decontam, mixture, quality

    return {"op2_mixture": mixture.oracle_sql(), "op6_decontamination": decontam.ORACLE_SQL, "op8_quality_rules": quality.ORACLE_SQL}
