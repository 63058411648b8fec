"""The queries opN_<name> over the test tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.llm import decontaminate, html_extract, jaccard, licenses, mixing, pii, quality, sharding, toxicity, url_filters
from corpusgraph.llm.common import read_table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filters.judge(url_filters.page_captures(pages), url_filters.page_list(pages))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3 = jaccard.JaccardParams(shingle=3, percent=90, light=3, spread=1.3)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read_table(spark, sf_dir, "documents"), p=OP3)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocate(read_table(spark, sf_dir, "documents")).drop("source")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignments(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.inspect(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filters.oracle_sql(),
        "op2_quality_rules": quality.oracle_sql(),
        "op3_jaccard_join": jaccard.oracle_sql(OP3),
        "op5_source_mix": mixing.oracle_sql(),
        "op6_sharding": sharding.oracle_sql(),
        "op10_decontaminate": decontaminate.oracle_sql(),
    }
