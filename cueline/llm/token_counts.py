"""Token counts through a digest cache.

A text's digest is SHA-256 of its normalised content; a tokenizer's version is the SHA-256 of its file. Counts are stored
by both. Counting joins the corpus' digests to the stored counts, encodes each distinct missing text once,
appends the new counts and joins again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, fresh_path, returning, small_batches
from .tokenizing import CountEncoder, encoder

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column) -> Column:
    """Runs of spaces, tabs and line ends become one space; the tokenizer drops white space, so counts are unchanged."""
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's counts for one tokenizer version; none if the cache does not exist yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    # appends of two runs at once may overlap
    return found.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_misses(docs: DataFrame, *, text: str, tokenizer: str, cache: str, version: str) -> None:
    """Encode each distinct text that the cache lacks, and append its count."""
    spark = docs.sparkSession
    small_batches(spark, 4096)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(CountEncoder, tokenizer)
        for b in batches:
            n = enc.count(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), b.column("digest").cast(pa.binary()), pa.array(n, pa.int64())], ["version", "digest", "n_tokens"])

    keyed = docs.select(content_digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    # copies meet within a task before the exchange, so one text with a third of all rows costs a row per task
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored_counts(spark, cache, version), "digest", "left_anti")
    misses.mapInArrow(returning(encode), CACHE_SCHEMA).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, *, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text", cache: str | None = None) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit.

    ``tokenizer`` is a .json file of the tokenizers library whose tokens hold no white space. ``cache`` is the
    folder of stored counts; without one a new cache is begun in the shared folder. Null texts count as
    empty: 0 bytes, 0 tokens. Every row, repeated or with a null key, gives a row. Other columns are ignored.
    """
    spark = docs.sparkSession
    cache = cache or fresh_path(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    append_misses(docs, text="text", tokenizer=tokenizer, cache=cache, version=version)
    rows = docs.select("key", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest"))
    # a written table, so that a digest of many rows can be split: nothing stands between exchange and join
    counts = Staged(stored_counts(spark, cache, version), "counts").df
    out = rows.join(counts, "digest", "left")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
