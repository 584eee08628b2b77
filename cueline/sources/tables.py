"""Jobs' JSON files to tables and back, and text files that jobs export."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions import time as M
from cueline.operators.timeline import joined_lines
from cueline.schema import ENVELOPES

# Fixed value: the head of the block list that a decider reads.
BLOCK_LIST_HEAD = """# Transcript Blocks For Editing

Use block IDs when returning edit decisions. Do not invent timestamps.

Expected output shape:

```json
{ "edit_decisions": [{ "block_id": "B0001", "decision": "keep", "reason": "" }] }
```
"""


#: File names that say what a file holds and not whose it is: such a file's job is its folder.
COMMON_NAMES = ("transcript", "sentence_index", "sentences", "index", "blocks", "topic_blocks", "edit_plan", "plan", "timeline", "quality", "quality_report")


def job_of_path(path: Column) -> Column:
    """A file's name without folder and ending, or, of files named for what they hold (``runs/<job>/transcript.json``), the folder's name."""
    parts = F.split(path, "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.when(F.lower(name).isin(*COMMON_NAMES) & (F.size(parts) > 1), F.url_decode(F.try_element_at(parts, F.lit(-2)))).otherwise(F.url_decode(name))


def read_table(spark: SparkSession, path: str, kind: str, part: str | None = None) -> DataFrame:
    """Rows (job_id, pos, envelope fields, row fields) of a list in jobs' JSON files, one object a file; byte order marks are skipped, junk stops the query."""
    head, lists = ENVELOPES[kind]
    part = part or next(iter(lists))
    fields = ", ".join([*([head] if head else []), f"{part} array<struct<{_colons(lists[part])}>>"])
    files = spark.read.schema(fields).option("multiLine", True).option("mode", "FAILFAST").json(path)
    files = files.withColumn("job_id", job_of_path(F.input_file_name()))
    envelope = [f for f in files.columns if f not in (part, "job_id")]
    return files.select("job_id", *envelope, F.posexplode(part).alias("pos", "row")).select("job_id", F.col("pos").cast("long").alias("pos"), *envelope, "row.*")


def _colons(ddl: str) -> str:
    from cueline.schema import rows_of

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows_of(ddl))


def to_json(rows: DataFrame, part: str, envelope: Mapping[str, Column] | None = None) -> DataFrame:
    """(job_id, json): each job's rows as one indented object, nulls written."""
    fields = [c for c in rows.columns if c not in ("job_id", "pos", *(envelope or {}))]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("row")))), lambda x: x.row)
    head = [F.first(c).alias(n) for n, c in (envelope or {}).items()]
    out = rows.groupBy("job_id").agg(*head, listed.alias(part))
    return out.select("job_id", F.to_json(F.struct(*(envelope or {}), part), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def srt(rows: DataFrame) -> DataFrame:
    """(job_id, srt) of rows (job_id, pos, start, end, text): numbered in order, a blank line between."""
    from cueline.operators.windows import ordered

    block = F.concat(F.row_number().over(ordered()).cast("string"), F.lit("\n"), M.srt_time(F.col("start")), F.lit(" --> "), M.srt_time(F.col("end")), F.lit("\n"), F.col("text"))
    return rows.withColumn("block", block).groupBy("job_id").agg(F.concat(joined_lines(F.col("pos"), F.col("block"), "\n\n"), F.lit("\n")).alias("srt"))


def block_line() -> Column:
    speaker = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit(" | spk="), F.col("speaker"))).otherwise("")
    return F.concat(
        F.lit("["), F.col("id"), F.lit(" | "), M.compact_time(F.col("start")), F.lit("-"), M.compact_time(F.col("end")), F.lit(" | "), F.col("sentence_count").cast("string"), F.lit(" sentences"), speaker, F.lit("]")
    )


def block_list(blocks: DataFrame) -> DataFrame:
    """(job_id, markdown): the compact list of blocks that a decider reads."""
    entry = F.concat(block_line(), F.lit("\n"), F.col("text"))
    return blocks.groupBy("job_id").agg(F.concat(F.lit(BLOCK_LIST_HEAD + "\n"), F.rtrim(joined_lines(F.col("pos"), entry, "\n\n"), F.lit(" \n")), F.lit("\n")).alias("markdown"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(job_of_path(F.input_file_name()).alias("job_id"), F.col("value").alias("text"))


def read_frames(spark: SparkSession, path: str, *, interval: float, base: float = 0.0) -> DataFrame:
    """Frames (job_id, pos, ts, image) of files frame_*.png; a job is a folder, and a frame's number in its name orders it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.png").option("recursiveFileLookup", True).load(path)
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    number = F.regexp_extract("path", r"frame_(\d+)\.png$", 1).cast("long")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("job_id").orderBy("number", "path")) - 1
    rows = files.select(folder.alias("job_id"), number.alias("number"), "path", F.col("content").alias("image"))
    return rows.withColumn("pos", pos.cast("long")).select("job_id", "pos", (F.lit(base) + F.col("pos") * interval).alias("ts"), "image")


def write_texts(rows: DataFrame, column: str, folder: str, ending: str) -> None:
    """One text file a job, written from the driver one job at a time: an export of finished documents, not a table."""
    os.makedirs(folder, exist_ok=True)
    for r in rows.select("job_id", column).toLocalIterator():
        with open(os.path.join(folder, f"{r['job_id']}{ending}"), "w", encoding="utf-8") as f:
            f.write(r[column])
