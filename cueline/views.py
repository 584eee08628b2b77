"""The driver tables seen as transcripts, frames, detections and edit plans.

Times are whole milliseconds, so that sums are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: a turn lasts 20 ms a character."""
    t = table(spark, sf_dir, "conversations")
    length, gap = 20 * F.length("text"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 5) * 400
    before = F.sum(length + gap).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    id_ = F.format_string("T%04d", F.col("turn") + 1)
    return t.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("pos"), id_.alias("id"), start.alias("start"), (start + length).alias("end"), "text", F.col("role").alias("speaker"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each turn, with the pause after it."""
    from cueline.operators.windows import pauses, with_ids

    return with_ids(pauses(segments(spark, sf_dir).drop("id"), None), "S")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", ts.alias("ts"), "event_type", "value")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recognised samples: errors are blank, every seventh has a character more in front."""
    e = events(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id")) - 1
    text = F.when(F.col("event_type") == "error", "").when(F.col("event_id") % 7 == 0, F.concat(F.lit("C"), F.col("event_type"))).otherwise(F.col("event_type"))
    return e.select("job_id", pos.cast("long").alias("pos"), "ts", text.alias("text"), (F.floor("value") / 500).alias("score"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("job_id", "ts", (F.col("event_type") != "error").alias("has_subtitle"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames: a signature's bits are the signs of the 64 numbers, two halves of 32."""
    half = lambda a: F.aggregate(F.slice("embedding", a, 32), F.lit(0).cast("long"), lambda n, x: n * 2 + (x > 0).cast("long"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("job_id"), F.col("vec_id").alias("pos"), (F.col("vec_id") * 40).alias("ts"), F.array(half(1), half(33)).alias("signature"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the blocks of one timeline for each source."""
    d = table(spark, sf_dir, "documents")
    before = F.sum(20 * F.col("n_chars")).over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return d.select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("pos"), F.format_string("B%04d", F.col("doc_id")).alias("id"), start.alias("start"), (start + 20 * F.col("n_chars")).alias("end"), "text",
        (F.col("doc_id") % 9 + 1).cast("int").alias("sentence_count"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("speaker"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as decisions: clean documents of good quality are kept."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("pos"), F.format_string("B%04d", F.col("doc_id")).alias("block_id"), F.when(good, "keep").otherwise("delete").alias("decision"),
        F.lit("").alias("reason"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("title "), F.col("doc_id").cast("string"))).otherwise("").alias("title"), (F.col("quality") * 0.5 + 0.25).alias("confidence"),
    )


#: The same views in SQL, as common table expressions.
SQL = {
    "segments": """segments AS (SELECT conv_id AS job_id, turn AS pos, printf('T%04d', turn + 1) AS id, coalesce(sum(d + g) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_,
        coalesce(sum(d + g) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + d AS end_, text, role AS speaker
        FROM (SELECT *, 20 * length(text) AS d, ((conv_id * 7 + turn * 13) % 5) * 400 AS g FROM conversations))""",
    "sentences": """sentences AS (SELECT job_id, pos, start_, end_, text, speaker, printf('S%04d', row_number() OVER w) AS id,
        coalesce(greatest(0, lead(start_) OVER w - end_), 0) AS pause FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY pos))""",
    "ev": "ev AS (SELECT user_id AS job_id, event_id, epoch_us(ts) // 1000 AS ts, event_type, value FROM events)",
    "samples": """samples AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS pos, ts,
        CASE WHEN event_type = 'error' THEN '' WHEN event_id % 7 = 0 THEN 'C' || event_type ELSE event_type END AS text, floor(value) / 500 AS score FROM ev)""",
    "blocks": """blocks AS (SELECT source AS job_id, doc_id AS pos, printf('B%04d', doc_id) AS id, coalesce(sum(20 * n_chars) OVER w, 0)::BIGINT AS start_, coalesce(sum(20 * n_chars) OVER w, 0)::BIGINT + 20 * n_chars AS end_, text,
        (doc_id % 9 + 1)::INT AS sentence_count, CASE WHEN doc_id % 3 = 0 THEN lang END AS speaker FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "decisions": """decisions AS (SELECT d.source AS job_id, l.doc_id AS pos, printf('B%04d', l.doc_id) AS block_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'keep' ELSE 'delete' END AS decision,
        CASE WHEN l.doc_id % 2 = 0 THEN 'title ' || l.doc_id ELSE '' END AS title, quality * 0.5 + 0.25 AS confidence FROM labels l JOIN documents d USING (doc_id))""",
    "timeline": """timeline AS (SELECT d.job_id, d.pos, d.block_id AS id, b.start_, b.end_, d.decision, coalesce(nullif(d.title, ''), b.text) AS text, d.confidence
        FROM decisions d JOIN blocks b ON b.job_id = d.job_id AND b.id = d.block_id)""",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
