"""Transcript segments to sentences, and sentences to topic blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from cueline.functions import text as T

from .windows import ordered, pauses, with_ids


def _timed_parts(segments: DataFrame) -> Column:
    """array<struct<text, start, end>> of a segment's sentences, times shared out by length."""
    parts = F.col("parts")
    size = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, p: n + F.length(p))
    at = lambda chars: F.col("start") + (F.col("end") - F.col("start")) * chars / size
    return F.transform(
        parts,
        lambda p, i: F.struct(
            p.alias("text"), F.when(i == 0, F.col("start")).otherwise(at(before(i))).alias("start"), F.when(i == F.size(parts) - 1, F.col("end")).otherwise(at(before(i) + F.length(p))).alias("end")
        ),
    )


def _align(text_parts: list[str], chars: list[tuple[str, float, float]], start: float, end: float) -> list[dict]:
    """Give each part the times of its characters; a mark of the text that the recogniser left out takes none."""
    marks = set(T.MARKS)
    out, at = [], 0
    for part in text_parts:
        taken = []
        for c in part:
            if at >= len(chars):
                break
            heard = chars[at][0]
            if c in marks and heard != c and heard not in marks:
                continue
            taken.append(chars[at])
            at += 1
        if taken:
            out.append({"text": part, "start": taken[0][1], "end": taken[-1][2]})
    return out or [{"text": "".join(text_parts), "start": start, "end": end}]


_TIMED = Y.ArrayType(Y.StructType([Y.StructField("text", Y.StringType()), Y.StructField("start", Y.DoubleType()), Y.StructField("end", Y.DoubleType())]))


@F.pandas_udf(_TIMED)
def _aligned(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for parts, texts, starts, ends in rows:
        yield pd.Series(
            [
                _align(list(p), [(c["text"], c["start"], c["end"]) for c in t if str(c["text"]).strip()], a, b)
                for p, t, a, b in zip(parts, texts, starts, ends, strict=True)
            ]
        )


def split_segments(segments: DataFrame, *, timed: bool = True) -> DataFrame:
    """Sentences (job_id, pos, source_segment_id, start, end, text, speaker) of segments (job_id, pos, id, start, end, text, speaker[, chars]).

    A segment's sentences follow its characters' times where it has any; without, its time is shared out by length. Blank texts give none.
    """
    rows = segments.withColumn("norm", T.squeeze(F.coalesce("text", F.lit("")))).filter("norm <> ''").withColumn("parts", T.sentence_parts(F.col("norm")))
    rows = rows.withColumn("parts", F.when(F.size("parts") == 0, F.array("norm")).otherwise(F.col("parts")))
    if timed and "chars" in segments.columns:
        known = F.size(F.coalesce("chars", F.expr("CAST(array() AS ARRAY<STRUCT<text: STRING, start: DOUBLE, end: DOUBLE>>)"))) > 0
        plain = rows.filter(~known).withColumn("timed", _timed_parts(rows))
        exact = rows.filter(known).withColumn("timed", _aligned("parts", "chars", "start", "end"))
        rows = plain.unionByName(exact)
    else:
        rows = rows.withColumn("timed", _timed_parts(rows))
    rows = rows.select("job_id", F.col("pos").alias("segment_pos"), F.col("id").alias("source_segment_id"), "speaker", F.posexplode("timed").alias("part", "timed"))
    w = Window.partitionBy("job_id").orderBy("segment_pos", "part")
    return rows.select("job_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "source_segment_id", "timed.start", "timed.end", "timed.text", "speaker")


def sentence_index(segments: DataFrame) -> DataFrame:
    """Sentences with ids S0001, ... and the pause after each."""
    return with_ids(pauses(split_segments(segments)), "S")


def number_blocks(sentences: DataFrame, *, min_duration: float = 20, max_duration: float = 60, split_pause: float = 1.2) -> DataFrame:
    """block_no of each sentence (job_id, pos, start, end, text, pause_after), from 1.

    The rule looks at the running block's first sentence, so a job is folded in order: once, over sorted rows that pass through in Arrow batches.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, number, first, last_end, last_pause = None, 0, None, 0.0, 0.0
        for b in batches:
            numbers = []
            for now, start, end, opens, pause in zip(*(b.column(c).to_pylist() for c in ("job_id", "start", "end", "opens", "pause_after")), strict=True):
                if first is None or now != job:
                    job, number, first = now, 1, start
                else:
                    long = last_end - first >= min_duration
                    if long and last_pause >= split_pause or end - first > max_duration or long and opens:
                        number, first = number + 1, start
                numbers.append(number)
                last_end, last_pause = end, pause
            yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("pos"), pa.array(numbers, pa.int64())], ["job_id", "pos", "block_no"])

    kind = sentences.schema["job_id"].dataType.simpleString()
    narrow = sentences.select("job_id", F.col("pos").cast("long").alias("pos"), "start", "end", T.opens_section(F.col("text")).alias("opens"), "pause_after")
    numbers = narrow.repartition("job_id").sortWithinPartitions("job_id", "pos").mapInArrow(fold, f"job_id {kind}, pos long, block_no long")
    return sentences.join(numbers, ["job_id", "pos"])


def speaker_of() -> Column:
    """The one speaker of a group, or null."""
    s = F.nullif("speaker", F.lit(""))
    return F.when(F.count_distinct(s) == 1, F.max(s))


def topic_blocks(sentences: DataFrame, **rule: float) -> DataFrame:
    """Blocks (job_id, pos, id, start_sentence_id, end_sentence_id, start, end, text, sentence_count, speaker) of an index."""
    rows = number_blocks(sentences, **rule)
    blocks = rows.groupBy("job_id", "block_no").agg(
        F.min_by("id", "pos").alias("start_sentence_id"), F.max_by("id", "pos").alias("end_sentence_id"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "").alias("text"), F.count("*").cast("int").alias("sentence_count"), speaker_of().alias("speaker"),
    )
    return blocks.withColumns({"pos": F.col("block_no") - 1, "id": F.format_string("B%04d", "block_no")}).drop("block_no")


def job_text(rows: DataFrame) -> DataFrame:
    """Each job's whole text."""
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "").alias("text"))


def quality(index: DataFrame, *, second: float = 1, rounded: bool = True) -> DataFrame:
    """One row a job: numbers that tell a usable transcript from a bad one, a score, a recommendation and its reasons.

    ``second`` is a second in the unit of the index's times: spans meet their limits in that unit, so that whole milliseconds are compared exactly. Without ``rounded``, ratios, seconds and score
    are left as computed.
    """
    span = F.col("end") - F.col("start")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "")
    q = index.groupBy("job_id").agg(
        F.count("*").alias("sentence_count"), (F.max("end") - F.min("start")).alias("duration"), F.max(span).alias("max_sentence_duration"), F.count_if(span > 30 * second).alias("long_sentence_count"), whole.alias("t")
    )
    q = q.withColumns({"noise_token_ratio": T.noise_share(F.col("t")), "chinese_char_ratio": T.han_share(F.col("t")), "repeated_char_run_count": T.repeated_runs(F.col("t"))})
    long, noise, han, runs, most = (F.col(c) for c in ("long_sentence_count", "noise_token_ratio", "chinese_char_ratio", "repeated_char_run_count", "max_sentence_duration"))
    loss = (
        F.least(F.lit(0.35), 35 * long / 1000) + F.least(F.lit(0.25), 1.2 * noise) + F.when(han < 0.55, 0.20).otherwise(0.0)
        + F.least(F.lit(0.15), runs / 100) + F.when(most > 90 * second, 0.15).otherwise(0.0)
    )
    score = F.greatest(F.lit(0.0), 1 - loss)
    reasons = F.filter(
        F.array(
            F.when(most > 60 * second, "sentence_timestamps_have_large_spans"), F.when(long > 0, "many_sentences_are_longer_than_30_seconds"), F.when(noise > 0.08, "noise_tokens_are_frequent"),
            F.when(han < 0.55, "recognized_text_has_low_chinese_character_ratio"), F.when(runs > 0, "recognized_text_contains_repeated_character_runs"),
        ),
        lambda r: r.isNotNull(),
    )
    q = q.withColumns({"score": score, "reasons": reasons})
    bad = (F.bround("score", 3) < 0.7) | (long > 0) | (most > 60 * second)
    q = q.withColumn("recommendation", F.when(bad, "prefer_subtitle_or_ocr").otherwise("asr_usable")).withColumns({c: F.col(c) / second for c in ("duration", "max_sentence_duration")})
    digits = {"duration": 3, "max_sentence_duration": 3, "noise_token_ratio": 4, "chinese_char_ratio": 4, "score": 3} if rounded else {}
    return q.withColumns({c: F.bround(c, n) for c, n in digits.items()}).drop("t")
