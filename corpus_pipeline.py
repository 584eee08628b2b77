"""Corpus pipeline: documents through five stages, each calling one operator of the llm subpackage.

Toxic documents go, one document of each group of near duplicates stays, documents with benchmark passages go, the rest is mixed to target weights (a row for each
time that a document is taken), and the mix is written as token shards. Stages tell rows apart by file and row number, so ``doc_id`` may be null or shared. Nulls in any
column, empty texts, repeated rows, empty tables and further columns of any name pass through every stage; a stage's decisions are joined to whole rows by a broadcast
of the rows that go, and by an exchange only beyond ``BROADCAST_ROWS`` of them. Each stage begins with a collection of the executors' heaps (``shrink_heaps``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm import decontaminate, jaccard, mixing, tokenizing, toxicity, wavelet
from cueline.llm.common import Staged, documents, shrink_heaps, with_row_id, without_rows


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, trained on the labelled documents among them, does not reject."""
    shrink_heaps(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(toxicity.training_rows(docs, labels)))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id (null last) of each group that links join. Rows without words have no link, so all of them stay."""
    shrink_heaps(spark)
    rows, row = with_row_id(docs)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    groups = jaccard.near_duplicates(rows.select(key.alias("key"), "text"), key="key")
    return without_rows(rows, row, groups.filter("n_shingles > 0 AND key <> component_id").select("key.row"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an occurrence of a benchmark window."""
    shrink_heaps(spark)
    rows, row = with_row_id(docs)
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row)
    return without_rows(rows, row, found.filter("contaminated").select(row))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a row. Its order is drawn from id and text, so that it does not hang on where rows lie."""
    shrink_heaps(spark)
    return mixing.take_mix(docs, sources=F.array("source"), order=F.xxhash64("doc_id", "text"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token shards; what the files hold of each row."""
    shrink_heaps(spark)
    return wavelet.token_output(docs, tokenizer=tokenizing.vocabulary_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The stages learn weights, follow links and write token files: SQL can't express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = Staged(stage(spark, docs, sf_dir), f"stage-{name}").df
    return docs
