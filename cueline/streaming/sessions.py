"""Streaming forms of the sessionizing operators.

Sources are any streams of rows with an event time ``at`` (timestamp) beside the times in seconds. A watermark bounds the state; rows later than it are dropped,
which batch operators do not do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueline.functions import text as T
from cueline.operators.samples import Event


def presence_sessions(detections: DataFrame, *, interval: float, max_gap: float, delay: str = "1 minute") -> DataFrame:
    """Runs of hits (job_id, at, has_subtitle) no more than interval + max_gap apart: job_id, first_at, last_at, hits. Widen and coalesce them downstream."""
    gap = f"{round((interval + max_gap) * 1_000_000)} microseconds"
    hits = detections.filter("has_subtitle").withWatermark("at", delay)
    runs = hits.groupBy("job_id", F.session_window("at", gap)).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("hits"))
    return runs.select("job_id", "first_at", "last_at", "hits")


EVENT_SCHEMA = "job_id {kind}, start double, end double, text string, score double"
_STATE = "ts array<double>, texts array<string>, scores array<double>, last_ms long"


def merge_samples_stream(samples: DataFrame, *, interval: float, min_duration: float = 0.4, max_gap: float | None = None, delay: str = "1 minute") -> DataFrame:
    """Subtitle events of a stream of samples (job_id, at, ts, text, score), emitted when a blank, a gap, another text or the watermark ends them.

    The rule is that of the batch operator; the state of a job is the samples of its open event.
    """
    limit = interval * 1.5 if max_gap is None else max_gap
    kind = samples.schema["job_id"].dataType.simpleString()

    def closed(ts: list[float], event: Event, scores: list[float]) -> list[tuple]:
        end = ts[-1] + interval if ts else 0.0
        return [(round(ts[0], 3), round(end, 3), event.vote(), round(sum(scores) / len(scores), 4))] if ts and end - ts[0] >= min_duration else []

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, texts, scores = (list(x) for x in state.get[:3]) if state.exists else ([], [], [])
        last_ms = state.get[3] if state.exists else 0
        event, out = Event(), []
        for t, s in zip(texts, scores, strict=True):
            event.add(t, s)
        if state.hasTimedOut:
            out += closed(ts, event, scores)
            state.remove()
        else:
            parts = list(batches)
            rows = pd.concat(parts).sort_values("ts", kind="stable") if parts else pd.DataFrame(columns=["ts", "text", "score", "at"])
            for now, text, score, at in zip(rows["ts"], rows["text"], rows["score"], rows["at"], strict=True):
                goes_on = ts and text and now - (ts[-1] + interval) <= limit and event.takes(text)
                if not goes_on:
                    out += closed(ts, event, scores)
                    ts, texts, scores, event = [], [], [], Event()
                if text:
                    ts.append(float(now))
                    texts.append(text)
                    scores.append(float(score))
                    event.add(text, float(score))
                    last_ms = int(pd.Timestamp(at).timestamp() * 1000)
            if ts:
                state.update((ts, texts, scores, last_ms))
                # no later sample can join once the watermark has passed the gap
                state.setTimeoutTimestamp(max(last_ms + int((interval + limit) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame([(*key, *r) for r in out], columns=["job_id", "start", "end", "text", "score"])

    clean = samples.withColumn("text", T.subtitle_text(F.coalesce("text", F.lit("")))).withWatermark("at", delay)
    return clean.groupBy("job_id").applyInPandasWithState(step, EVENT_SCHEMA.format(kind=kind), _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_stream(frames: DataFrame, *, threshold: int = 16) -> DataFrame:
    """Frames (job_id, pos, signature array<long>) of a stream with action and source_pos; the state of a job is its last signature and the source of its island."""
    kind = frames.schema["job_id"].dataType.simpleString()

    def far(a: list[int], b: list[int]) -> bool:
        return len(a) != len(b) or sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True)) > threshold

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, source = state.get if state.exists else (None, None)
        out = []
        for pos, signature in pd.concat(list(batches)).sort_values("pos", kind="stable")[["pos", "signature"]].itertuples(index=False):
            if signature is None:
                last = source = None
                out.append((*key, pos, "skipped", None))
                continue
            now = [int(x) for x in signature]
            new = last is None or far([int(x) for x in last], now)
            source, last = (pos if new else source), now
            out.append((*key, pos, "ocr" if new else "reused", source))
        if last is None:
            state.remove()
        else:
            state.update((last, source))
        yield pd.DataFrame(out, columns=["job_id", "pos", "action", "source_pos"]).astype({"source_pos": "Int64"})

    schema = f"job_id {kind}, pos long, action string, source_pos long"
    return frames.groupBy("job_id").applyInPandasWithState(step, schema, "last array<bigint>, source long", "append", GroupStateTimeout.NoTimeout)
