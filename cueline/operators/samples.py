"""Recognised samples to subtitle events.

Blanks and gaps alone decide where an event must end, so samples are first parted by windows into stretches; the sequential rule runs
in an Arrow kernel per stretch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions import text as T

from .windows import islands, ordered


def hard_stretches(samples: DataFrame, *, gap_limit: float, interval: float) -> DataFrame:
    """Samples (job_id, pos, ts, text, score) that are not blank, with their normalised text and the number of their stretch.

    A stretch ends at a blank sample and where the next sample starts more than ``gap_limit`` after this one's end.
    """
    df = samples.withColumn("text", T.subtitle_text(F.coalesce("text", F.lit(""))))
    w = ordered("ts", "pos")
    blank_before = F.coalesce(F.lag("text").over(w) == "", F.lit(True))
    gap = F.coalesce(F.col("ts") - (F.lag("ts").over(w) + interval) > gap_limit, F.lit(True))
    df = df.withColumn("_cut", (F.col("text") == "") | blank_before | gap)
    return islands(df, F.col("_cut"), "stretch", ("ts", "pos")).drop("_cut").filter("text <> ''")


def _distance(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=True))


def _noise_at_edge(long: str, short: str) -> bool:
    if len(long) != len(short) + 1:
        return False
    plain = lambda c: c.isascii() and c.isalnum()
    return plain(long[0]) and long[1:] == short or plain(long[-1]) and long[:-1] == short


def _same_subtitle(a: str, b: str) -> bool:
    return a == b or len(a) == len(b) and _distance(a, b) <= 1 or _noise_at_edge(a, b) or _noise_at_edge(b, a)


def _han(s: str) -> bool:
    return all("一" <= c <= "鿿" for c in s)


class Event:
    """The samples of one event, with running statistics by text."""

    def __init__(self) -> None:
        self.count: dict[str, int] = {}
        self.total: dict[str, float] = {}
        self.first: dict[str, int] = {}
        self.last: dict[str, int] = {}
        self.n = 0
        self.latest = ""

    def add(self, text: str, score: float) -> None:
        self.count[text] = self.count.get(text, 0) + 1
        self.total[text] = self.total.get(text, 0.0) + score
        self.first.setdefault(text, self.n)
        self.last[text] = self.n
        self.n += 1
        self.latest = text

    def vote(self) -> str:
        """The text that stands for the event: see the rules in order."""
        texts = sorted(self.count, key=self.first.__getitem__)
        if len(texts) == 1:
            return texts[0]
        if all(len(t) == len(texts[0]) and _distance(texts[0], t) <= 1 for t in texts):
            return texts[0]  # readings one character apart: the first observed
        most = max(self.count.values())
        tied = [t for t in texts if self.count[t] == most]
        best = max(tied, key=lambda t: (self.total[t], -self.first[t]))
        if len(tied) == 1 or len({len(t) for t in texts}) > 1:
            return best
        by_place: dict[tuple[int, str], list[float]] = defaultdict(lambda: [0, 0.0])
        for t in texts:
            for place in enumerate(t):
                by_place[place][0] += self.count[t]
                by_place[place][1] += self.total[t]
        support = lambda t: tuple(sum(by_place[p][i] for p in enumerate(t)) for i in (0, 1))
        return max(tied, key=lambda t: (*support(t), self.count[t], self.total[t], self.last[t]))

    def takes(self, text: str) -> bool:
        if text in self.count:
            return True
        for known in dict.fromkeys((self.latest, self.vote())):
            if _same_subtitle(known, text):
                if len(known) == len(text) < 4 and _han(known) and _han(text) and _distance(known, text) == 1:
                    continue  # short words that differ in one character are different words
                return True
            if max(self.count.values()) < 2 and len(known) == len(text) >= 8 and 1 < _distance(known, text) <= max(2, len(text) // 8):
                return True
        return False


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of sorted samples: a stretch's rows follow one another, over batches too."""
    at, number = None, 0
    event, first, last, total = Event(), 0.0, 0.0, 0.0
    job_type = None
    done: list[tuple] = []

    def close() -> None:
        if event.n:
            done.append((*at, number, first, last, event.vote(), total / event.n))

    def batch() -> pa.RecordBatch:
        types = [job_type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.float64()]
        columns = list(zip(*done, strict=True)) if done else [()] * len(types)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["job_id", "stretch", "event", "first_ts", "last_ts", "text", "score"])
        done.clear()
        return made

    for b in batches:
        job_type = b.schema.field("job_id").type
        for row in zip(*(b.column(c).to_pylist() for c in ("job_id", "stretch", "ts", "text", "score")), strict=True):
            place, (ts, text, score) = row[:2], row[2:]
            if place != at or not event.takes(text):
                close()
                number = 0 if place != at else number + 1
                at, event, first, total = place, Event(), ts, 0.0
            event.add(text, score)
            last, total = ts, total + score
        yield batch()
    close()
    if done:
        yield batch()


def merge_samples(samples: DataFrame, *, interval: float, min_duration: float = 0.4, max_gap: float | None = None) -> DataFrame:
    """Subtitle events (job_id, pos, start, end, text, score) of samples (job_id, pos, ts, text, score).

    Samples are taken by time. Near readings of one text make an event, which a vote names; events shorter than ``min_duration`` are dropped.
    """
    gap_limit = interval * 1.5 if max_gap is None else max_gap
    parted = hard_stretches(samples, gap_limit=gap_limit, interval=interval)
    parted = parted.select("job_id", "stretch", "pos", F.col("ts").cast("double").alias("ts"), "text", F.col("score").cast("double").alias("score"))
    kind = samples.schema["job_id"].dataType.simpleString()
    schema = f"job_id {kind}, stretch long, event long, first_ts double, last_ts double, text string, score double"
    events = parted.repartition("job_id", "stretch").sortWithinPartitions("job_id", "stretch", "ts", "pos").mapInArrow(_events, schema)
    events = events.withColumn("last_ts", F.col("last_ts") + interval).filter(F.col("last_ts") - F.col("first_ts") >= min_duration)
    pos = F.row_number().over(Window.partitionBy("job_id").orderBy("stretch", "event")) - 1
    return events.select("job_id", pos.cast("long").alias("pos"), F.bround("first_ts", 3).alias("start"), F.bround("last_ts", 3).alias("end"), "text", F.bround("score", 4).alias("score"))


def exact_events(samples: DataFrame, *, interval: float, gap_limit: float) -> DataFrame:
    """Events of equal neighbouring texts, by windows alone."""
    parted = hard_stretches(samples, gap_limit=gap_limit, interval=interval)
    w = Window.partitionBy("job_id", "stretch").orderBy("ts", "pos")
    parted = parted.withColumn("_new", F.coalesce(F.lag("text").over(w) != F.col("text"), F.lit(True)).cast("int"))
    parted = parted.withColumn("event", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parted.groupBy("job_id", "stretch", "event").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.first("text").alias("text"), F.count("*").alias("n"))


def event_votes(samples: DataFrame) -> DataFrame:
    """Each event's exact best text: most often, then highest total score, then first. samples: job_id, event, pos, text, score."""
    by_text = samples.groupBy("job_id", "event", "text").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.min("pos").alias("first_pos"))
    best = F.max_by("text", F.struct("n", "total", -F.col("first_pos")))
    return by_text.groupBy("job_id", "event").agg(best.alias("text"), F.max("n").alias("votes"), F.count("*").alias("readings"))


def drop_trailing_credits(
    segments: DataFrame, *, max_gap: float = 12, min_rows: int = 4, min_duration: float = 15, words: tuple[str, ...] = T.CREDIT_WORDS, lines: tuple[str, ...] = T.SONG_LINES
) -> DataFrame:
    """Segments (job_id, pos, start, end, text, ...) without the credits at a job's end.

    The tail is the last run of segments no more than ``max_gap`` apart. It goes if it begins with a signal of credits, is long enough, and holds enough
    strong signals, or is a song whose lines repeat.
    """
    back = Window.partitionBy("job_id").orderBy(F.col("pos").desc())
    to_next = F.lead("start").over(ordered()) - F.col("end")
    df = segments.withColumn("_cut", F.coalesce(to_next > max_gap, F.lit(False)).cast("int"))
    df = df.withColumn("_tail", F.sum("_cut").over(back.rowsBetween(Window.unboundedPreceding, 0)) == 0)
    df = df.withColumns({"_signal": T.credit_signal(F.col("text"), words, lines), "_song": T.has_song_line(F.col("text"), lines)})
    tail = df.filter("_tail").groupBy("job_id").agg(
        F.count("*").alias("n"), F.min_by("_signal", "pos").alias("first"), F.min_by("start", "pos").alias("a"), F.max_by("end", "pos").alias("b"),
        F.count_if(F.col("_signal") > 0).alias("signals"), F.count_if(F.col("_signal") >= 2).alias("strong"), F.count_if("_song").alias("songs"),
        F.min_by(F.when(F.col("_song"), F.col("start")), F.when(F.col("_song"), F.col("pos"))).alias("song_a"),
        F.max_by(F.when(F.col("_song"), F.col("end")), F.when(F.col("_song"), F.col("pos"))).alias("song_b"),
    )
    worded = (F.col("strong") >= 2) & (F.col("signals") >= F.greatest(F.lit(3), F.floor(F.col("n") / 3)))
    sung = (F.col("n") >= 6) & (F.col("songs") >= 4) & (F.col("song_b") - F.col("song_a") >= 12)
    cut = (F.col("n") >= min_rows) & (F.col("first") > 0) & (F.col("b") - F.col("a") >= min_duration) & (worded | F.coalesce(sung, F.lit(False)))
    gone = tail.filter(cut).select("job_id", F.lit(True).alias("_gone"))
    return df.join(gone, "job_id", "left").filter(~(F.col("_tail") & F.coalesce("_gone", F.lit(False)))).select(*segments.columns)


def to_transcript(events: DataFrame, source: str | None = None) -> DataFrame:
    """Events as transcript segments with ids ocr_0001, ..."""
    out = events.withColumn("id", F.format_string("ocr_%04d", F.row_number().over(ordered())))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<text: STRING, start: DOUBLE, end: DOUBLE>>)")
    return out.select("job_id", "pos", F.lit(source).cast("string").alias("source"), F.lit("zh").alias("language"), "id", "start", "end", "text", none.alias("chars"), F.lit(None).cast("string").alias("speaker"))
