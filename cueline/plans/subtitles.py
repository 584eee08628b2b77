"""From frames to a transcript: the whole chain, over many jobs at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.operators import recognition, samples, windows


def read_planned(planned: DataFrame, frames: DataFrame, make: Callable[[], recognition.Recognizer], *, min_score: float, name: str) -> DataFrame:
    """Samples (job_id, pos, ts, text, score) of all planned frames; the recogniser sees the frames to be read alone."""
    wanted = planned.filter("action = 'ocr'").select("job_id", "pos", *(["mode"] if "mode" in planned.columns else [F.lit("full").alias("mode")]))
    texts = recognition.read_frames(frames.select("job_id", "pos", "ts", "image").join(wanted, ["job_id", "pos"]), make, name=name)
    return windows.backfill(planned, windows.best_text(texts, min_score=min_score).select("job_id", "pos", "text", "score"))


def transcript_of_frames(
    frames: DataFrame, make: Callable[[], recognition.Recognizer], *, interval: float, threshold: int = 16, fast: bool = True, min_score: float = 0.7, source: str | None = None, name: str = "own"
) -> DataFrame:
    """Transcript segments of frames (job_id, pos, ts, image, signature)."""
    planned = windows.dedupe_frames(frames.select("job_id", "pos", "ts", "signature"), threshold=threshold, fast=fast)
    read = read_planned(planned, frames, make, min_score=min_score, name=name)
    return samples.to_transcript(samples.drop_trailing_credits(samples.merge_samples(read, interval=interval)), source)


def transcript_adaptive(
    frames: DataFrame,
    make: Callable[[], recognition.Recognizer],
    *,
    interval: float,
    detect_every: int = 2,
    max_gap: float | None = None,
    expand: float = 1.0,
    threshold: int = 128,
    cache: bool = False,
    min_score: float = 0.7,
    source: str | None = None,
    name: str = "own",
) -> DataFrame:
    """Like ``transcript_of_frames`` in two passes: every ``detect_every``-th frame tells where subtitles are, and only frames in those ranges are planned and read."""
    step = interval * detect_every
    seen = frames.filter(F.col("pos") % detect_every == 0).select("job_id", "ts", F.col("signature").isNotNull().alias("has_subtitle"))
    ranges = windows.presence_ranges(seen, interval=step, max_gap=step * 1.5 if max_gap is None else max_gap, expand=expand)
    near = windows.frames_in_ranges(frames, ranges, cell=max(60.0, step))
    narrow = near.select("job_id", "pos", "ts", "signature", *[c for c in ("range_no", "crop_signature", "crop_height") if c in near.columns])
    planned = windows.dedupe_frame_arrays(narrow, threshold=threshold, cache=cache)
    read = read_planned(planned, near, make, min_score=min_score, name=name)
    return samples.to_transcript(samples.drop_trailing_credits(samples.merge_samples(read, interval=interval)), source)
