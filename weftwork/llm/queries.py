"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm.bpe import public_bpe_report
from weftwork.llm.collocations import collocation_report
from weftwork.llm.decontaminate import contamination_report
from weftwork.llm.html_main import extract_main_text
from weftwork.llm.jaccard_join import jaccard_report
from weftwork.llm.langid import language_report
from weftwork.llm.lexical import lexical_report
from weftwork.llm.line_dedup import line_dedup_report
from weftwork.llm.maxent_lm import lm_report
from weftwork.llm.minhash import minhash_report
from weftwork.llm.quality import quality_report
from weftwork.llm.span_dedup import span_report
from weftwork.llm.toxicity import toxicity_report


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_documents(spark, sf_dir))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_bpe_report(_documents(spark, sf_dir))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(_documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_report(_documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_report(_documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_report(_documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation_report(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_span_dedup,
        op3_quality_rules,
        op4_html_extraction,
        op5_decontamination,
        op6_byte_bpe,
        op7_language_id,
        op8_toxicity,
        op9_lm_scoring,
        op10_jaccard_join,
        op11_minhash,
        op12_lexical_search,
        op13_collocations,
    )
}
