"""Operators on ordered rows: each job's rows are ordered by pos, and no window spans jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions import text as T


def ordered(*by: str) -> Window:
    return Window.partitionBy("job_id").orderBy(*(by or ("pos",)))


def islands(df: DataFrame, begins: Column, out: str = "island", by: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Number the runs that start where ``begins`` holds."""
    w = ordered(*by)
    return df.withColumn("_new", begins.cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def dedupe_frames(frames: DataFrame, *, threshold: int = 16, fast: bool = True) -> DataFrame:
    """Decide for each frame (job_id, pos, ts, signature array<long>) whether it is read, skipped or reuses the reading of its island's first frame.

    Adds action ('ocr', 'reused', 'skipped') and source_pos. A null signature is skipped and ends an island. Distances are taken to the frame before.
    """
    if not fast:
        return frames.withColumns({"action": F.lit("ocr"), "source_pos": F.col("pos")})
    w = ordered()
    far = F.coalesce(T.signature_distance(F.col("signature"), F.lag("signature").over(w)) > threshold, F.lit(True))
    df = islands(frames.withColumn("_far", far), F.col("signature").isNull() | F.col("_far"))
    own = Window.partitionBy("job_id", "island")
    source = F.min("pos").over(own)
    action = F.when(F.col("signature").isNull(), "skipped").when(F.col("_far"), "ocr").otherwise("reused")
    return df.withColumns({"action": action, "source_pos": F.when(F.col("signature").isNotNull(), source)}).drop("_far", "island")


def dedupe_frame_arrays(frames: DataFrame, *, threshold: int = 128, cache: bool = False) -> DataFrame:
    """Like ``dedupe_frames`` for frames with a crop: columns (job_id, pos, ts, signature[, range_no, crop_signature, crop_height]).

    A frame without a full signature is skipped. A crop of fitting height replaces the frame, and its signature, if there is one, is the one compared; mode tells
    how the frame is to be read. Comparison starts anew with each range. With ``cache`` a signature that was read before in the job, in whatever range, is 'cached' and
    becomes the source that later frames are compared with; only frames that are read enter the cache. Rows pass through sorted, so a worker holds one job's cache.
    """
    from cueline.operators.recognition import reading_mode

    for name, kind in (("range_no", "long"), ("crop_signature", "array<bigint>"), ("crop_height", "int")):
        if name not in frames.columns:
            frames = frames.withColumn(name, F.lit(None).cast(kind))
    mode = F.coalesce(reading_mode(F.col("crop_height")), F.lit("rec_frame"))
    match = F.when(mode == "rec_crop", F.coalesce("crop_signature", "signature")).otherwise(F.col("signature"))
    rows = frames.select("job_id", F.coalesce("range_no", F.lit(0)).cast("long").alias("range_no"), "pos", "ts", mode.alias("mode"), F.when(F.col("signature").isNotNull(), match).alias("match"))
    kind = frames.schema["job_id"].dataType.simpleString()

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, part, last, source, known = None, None, None, None, {}
        for b in batches:
            actions, sources = [], []
            for now, at, pos, match in zip(*(b.column(c).to_pylist() for c in ("job_id", "range_no", "pos", "match")), strict=True):
                if now != job:
                    job, part, known = now, None, {}
                if at != part:
                    part, last, source = at, None, None
                if match is None:
                    last = source = None
                    actions.append("skipped")
                elif cache and tuple(match) in known:
                    last, source = match, known[tuple(match)]
                    actions.append("cached")
                elif last is not None and len(last) == len(match) and sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(last, match, strict=True)) <= threshold:
                    last = match
                    actions.append("reused")
                else:
                    last, source = match, pos
                    known[tuple(match)] = pos
                    actions.append("ocr")
                sources.append(source)
            kept = ("job_id", "range_no", "pos", "ts", "mode")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(actions, pa.string()), pa.array(sources, pa.int64())], [*kept, "action", "source_pos"])

    rows = rows.withColumn("pos", F.col("pos").cast("long")).withColumn("ts", F.col("ts").cast("double"))
    dealt = rows.repartition("job_id").sortWithinPartitions("job_id", "range_no", "ts", "pos")
    return dealt.mapInArrow(plan, f"job_id {kind}, range_no long, pos long, ts double, mode string, action string, source_pos long")


def backfill(planned: DataFrame, read: DataFrame) -> DataFrame:
    """Give each frame the text and score read from its source frame (job_id, pos, text, score); blank without one."""
    read = read.select("job_id", F.col("pos").alias("source_pos"), "text", "score")
    out = planned.join(read, ["job_id", "source_pos"], "left")
    return out.select("job_id", "pos", "ts", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))


def dedupe_stats(planned: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return planned.groupBy("job_id").agg(count("ocr"), count("skipped"), count("reused"), count("cached"))


def coalesce_ranges(ranges: DataFrame) -> DataFrame:
    """Merge ranges (job_id, start, end) that overlap or touch."""
    w = ordered("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = ranges.withColumn("_open", F.coalesce(F.col("start") > reach, F.lit(True)))
    df = islands(df, F.col("_open"), by=("start", "end"))
    return df.groupBy("job_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def presence_ranges(
    detections: DataFrame, *, interval: Column | float, max_gap: Column | float, expand: Column | float = 1.0, start_bound: Column | float = 0.0, end_bound: Column | float | None = None, digits: int | None = 3
) -> DataFrame:
    """Time ranges (job_id, start, end) in which detections (job_id, ts, has_subtitle) hold.

    Hits no more than interval + max_gap apart, start to start, are one range; ranges are widened by ``expand``, cut to the bounds and merged where they touch.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    hits = detections.filter("has_subtitle").select("job_id", "ts")
    before = F.lag("ts").over(ordered("ts"))
    far = F.coalesce(F.col("ts") - (before + lit(interval)) > lit(max_gap), F.lit(True))
    runs = islands(hits.withColumn("_far", far), F.col("_far"), by=("ts",)).groupBy("job_id", "island").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    start = F.greatest(lit(start_bound), F.col("a") - lit(expand))
    end = F.col("b") + lit(interval) + lit(expand)
    if end_bound is not None:
        end = F.least(lit(end_bound), end)
    if digits is not None:
        start, end = F.bround(start, digits), F.bround(end, digits)
    return coalesce_ranges(runs.select("job_id", start.alias("start"), end.alias("end")).filter("end > start"))


def frames_in_ranges(frames: DataFrame, ranges: DataFrame, *, cell: float | None = None) -> DataFrame:
    """Frames (job_id, ts, ...) inside a range, start included and end not.

    The join's key is the job and, with ``cell``, the stretch of that length that holds the frame: jobs with many ranges then
    compare a frame with the ranges near it alone.
    """
    r = ranges.select(F.col("job_id").alias("r_job"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = (F.col("job_id") == F.col("r_job")) & (F.col("ts") >= F.col("r_start")) & (F.col("ts") < F.col("r_end"))
    if cell is None:
        return frames.join(r, inside, "left_semi")
    r = r.withColumn("r_cell", F.explode(F.sequence(F.floor(F.col("r_start") / cell), F.floor(F.col("r_end") / cell))))
    return frames.join(r, inside & (F.floor(F.col("ts") / cell) == F.col("r_cell")), "left_semi")


def best_text(texts: DataFrame, *, min_score: float = 0.7) -> DataFrame:
    """Each frame's best text: rows (job_id, pos, ts, idx, text, score) of good score that look like a subtitle, by score, then length, then place.

    A frame without one gets a blank sample.
    """
    t = T.subtitle_text(F.col("text"))
    good = (F.col("score") >= min_score) & T.looks_like_subtitle(F.col("text"))
    rank = F.struct(F.col("score"), F.length("t"), -F.col("idx"))
    rows = texts.withColumns({"t": t, "good": good})
    best = F.max_by(F.struct("t", "score"), F.when(F.col("good"), rank))
    out = rows.groupBy("job_id", "pos", "ts").agg(best.alias("best"), F.max("good").alias("any"))
    return out.select("job_id", "pos", "ts", F.when(F.col("any"), F.col("best.t")).otherwise("").alias("text"), F.when(F.col("any"), F.col("best.score")).otherwise(0.0).alias("score"))


def pauses(sentences: DataFrame, digits: int | None = 3) -> DataFrame:
    """pause_after: the time to the next sentence's start, 0 at least and for the last."""
    gap = F.lead("start").over(ordered()) - F.col("end")
    gap = F.bround(gap, digits) if digits is not None else gap
    return sentences.withColumn("pause_after", F.coalesce(F.greatest(gap * 0, gap), F.col("end") * 0))


def with_ids(df: DataFrame, prefix: str, by: tuple[str, ...] = ("pos",), out: str = "id") -> DataFrame:
    """Sequential ids by job, four digits at least."""
    return df.withColumn(out, F.format_string(f"{prefix}%04d", F.row_number().over(ordered(*by))))
