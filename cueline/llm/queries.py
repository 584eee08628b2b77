"""The subpackage's queries: one opN_<name> for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, html_text, jaccard, line_dedup, mixing, token_counts, tokenizing, toxicity, url_filter, wavelet
from .common import documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(documents(spark, sf_dir))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_output(documents(spark, sf_dir), tokenizer=tokenizing.vocabulary_path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer=tokenizing.vocabulary_path("word_bpe_49k.json"), limit=2048)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(url_filter.read_pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), key="doc_id", sources=F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats", "pattern")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_output": op3_token_output,
    "op4_token_counts": op4_token_counts,
    "op5_url_filter": op5_url_filter,
    "op6_decontaminate": op6_decontaminate,
    "op7_html_text": op7_html_text,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_fingerprints": op9_fingerprints,
    "op10_mixing": op10_mixing,
}

ORACLE: dict[str, str] = {"op2_line_dedup": line_dedup.oracle()}
