"""Recogniser results (JSON of several shapes) to rows, and readers that run a recogniser over frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions import text as T
from cueline.functions import time as M

ENGINES, MODEL_SIZES, MAX_CROP_HEIGHT = ("rapidocr", "ppocrv6"), ("tiny", "small", "medium"), 96


class Recognizer(Protocol):
    """Reads one image: (text, score, box) of each text found."""

    def read(self, image: bytes, mode: str) -> list[tuple[str, float, list[list[float]]]]: ...


_engines: dict[str, Callable[[], Recognizer]] = {}
_ready: dict[str, Recognizer] = {}


def register_engine(name: str, make: Callable[[], Recognizer]) -> None:
    _engines[name] = make


def check_engine(name: str, size: str | None = None) -> str:
    name = name.strip().lower()
    if name not in ENGINES and name not in _engines:
        raise ValueError(f"unknown recogniser {name!r}; known are {', '.join(sorted({*ENGINES, *_engines}))}")
    if size is not None and size.strip().lower() not in MODEL_SIZES:
        raise ValueError(f"unknown model size {size!r}; known are {', '.join(MODEL_SIZES)}")
    return name


def read_frames(frames: DataFrame, make: Callable[[], Recognizer], *, name: str = "own") -> DataFrame:
    """Texts (job_id, pos, ts, idx, text, score, box) of frames (job_id, pos, ts, image, mode). An engine is made once per Python worker."""
    kind = frames.schema["job_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ready:
            _ready[name] = make()
        for b in batches:
            rows = [
                {"job_id": r["job_id"], "pos": r["pos"], "ts": r["ts"], "idx": i, "text": t, "score": float(s), "box": box}
                for r in b.to_pylist()
                for i, (t, s, box) in enumerate(_ready[name].read(r["image"], r["mode"]))
            ]
            schema = pa.schema([b.schema.field("job_id"), ("pos", pa.int64()), ("ts", pa.float64()), ("idx", pa.int32()), ("text", pa.string()), ("score", pa.float64()), ("box", pa.list_(pa.list_(pa.float64())))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return frames.select("job_id", "pos", "ts", "image", "mode").mapInArrow(run, f"job_id {kind}, pos long, ts double, idx int, text string, score double, box array<array<double>>")


def read_speech(audio: DataFrame, make: Callable[[], Callable[[bytes], str]], *, name: str = "speech") -> DataFrame:
    """(job_id, payload) of sound (job_id, content binary): what a speech model, made once per Python worker, says as JSON; ``speech_segments`` reads it."""
    kind = audio.schema["job_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ready:
            _ready[name] = make()
        for b in batches:
            said = [_ready[name](v.as_py()) for v in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column("job_id"), pa.array(said, pa.string())], ["job_id", "payload"])

    return audio.select("job_id", "content").mapInArrow(run, f"job_id {kind}, payload string")


def engine(name: str) -> Callable[[], Recognizer]:
    """The maker of a registered engine."""
    known = check_engine(name)
    if known not in _engines:
        raise RuntimeError(f"no engine is registered for {known!r}; call register_engine")
    return _engines[known]


def reading_mode(crop_height: Column, rec_only: bool = True) -> Column:
    """How a frame is read: a found text crop of fitting height alone, the frame as one line, or in full."""
    if not rec_only:
        return F.lit("full")
    return F.when(crop_height.between(1, MAX_CROP_HEIGHT), "rec_crop").otherwise("rec_frame")


def _first(v: Column, kind: str, *names: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def _items(payload: Column) -> Column:
    """A result, or a list of results, as an array of variants; what wraps a result in ``res`` is taken off."""
    v = F.try_parse_json(payload)
    many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.transform(F.filter(many, lambda x: x.isNotNull()), lambda x: F.coalesce(F.try_variant_get(x, "$.res", "variant"), x))


def line_items(results: DataFrame) -> DataFrame:
    """One-line results (job_id, pos, payload) as (job_id, pos, idx, text, score); results without text are left out, but keep their place."""
    rows = results.select("job_id", "pos", F.posexplode(_items(F.col("payload"))).alias("idx", "v"))
    text, score = _first(F.col("v"), "string", "rec_text", "text"), _first(F.col("v"), "double", "rec_score", "score")
    return rows.select("job_id", "pos", "idx", text.alias("text"), F.coalesce(score, F.lit(0.0)).alias("score")).filter("coalesce(text, '') <> ''")


def text_items(results: DataFrame) -> DataFrame:
    """Full results as (job_id, pos, idx, text, score, box): boxes as corner points, [] where none is given."""
    rows = results.select("job_id", "pos", F.posexplode(_items(F.col("payload"))).alias("item", "v"))
    v = F.col("v")
    texts = F.coalesce(_first(v, "array<string>", "rec_texts", "rec_text", "texts"), F.array(_first(v, "string", "rec_texts", "rec_text", "texts")))
    scores = F.coalesce(_first(v, "array<double>", "rec_scores", "rec_score", "scores"), F.array(_first(v, "double", "rec_scores", "rec_score", "scores")))
    names = ("rec_polys", "dt_polys", "rec_boxes", "boxes")
    points, corners = _first(v, "array<array<array<double>>>", *names), _first(v, "array<array<double>>", *names)
    rows = rows.select("job_id", "pos", "item", F.posexplode(F.filter(texts, lambda t: t.isNotNull())).alias("place", "text"), scores.alias("scores"), points.alias("points"), corners.alias("corners"))
    none = F.expr("CAST(array() AS ARRAY<ARRAY<DOUBLE>>)")
    # a value that does not fit the asked type comes as null, inside arrays too
    corner, poly = F.get("corners", "place"), F.get("points", "place")
    flat = F.when((F.size(corner) == 4) & F.forall(corner, lambda x: x.isNotNull()), T.corner_points(corner))
    box = F.coalesce(flat, F.when(F.forall(poly, lambda p: p.isNotNull()), poly), none)
    w = Window.partitionBy("job_id", "pos").orderBy("item", "place")
    return rows.select("job_id", "pos", (F.row_number().over(w) - 1).alias("idx"), "text", F.coalesce(F.get("scores", "place"), F.lit(0.0)).alias("score"), box.alias("box"))


def best_item(items: DataFrame) -> DataFrame:
    """The item of highest score for each (job_id, pos), the first of equals."""
    return items.groupBy("job_id", "pos").agg(F.max_by(F.struct("text", "score"), F.struct("score", -F.col("idx"))).alias("b")).select("job_id", "pos", "b.text", "b.score")


def speech_segments(results: DataFrame, unit: str = "auto") -> DataFrame:
    """Transcript segments of speech results (job_id, payload): a list or one object, each with sentence_info, or text and timestamp.

    Sentences become segments of their own, with speaker; else an object is one segment, timed by its characters. Objects that are neither give none.
    """
    rows = results.select("job_id", F.posexplode(_items(F.col("payload"))).alias("item", "v"))
    v = F.col("v")
    info = F.try_variant_get(v, "$.sentence_info", "array<variant>")
    rows = rows.withColumns({"info": info, "text": _first(v, "string", "text"), "marks": _first(v, "array<array<double>>", "timestamps", "timestamp")})
    has = F.coalesce(F.size("info") > 0, F.lit(False))
    s = F.col("s")
    said = rows.filter(has).select("job_id", "item", F.posexplode("info").alias("part", "s")).filter("s IS NOT NULL")
    start, end = (M.mark_to_seconds(F.try_variant_get(s, f"$.{n}", "double"), unit) for n in ("start", "end"))
    speaker = F.coalesce(F.try_variant_get(s, "$.spk", "string"), F.try_variant_get(s, "$.speaker", "string"))
    chars_type = "ARRAY<STRUCT<text: STRING, start: DOUBLE, end: DOUBLE>>"
    empty = F.expr(f"CAST(array() AS {chars_type})")
    said = said.select("job_id", "item", "part", start.alias("start"), F.when(end <= start, start + 0.001).otherwise(end).alias("end"), F.coalesce(F.try_variant_get(s, "$.text", "string"), F.lit("")).alias("text"), empty.alias("chars"), speaker.alias("speaker"))
    plain = rows.filter(~has & (F.coalesce("text", F.lit("")) != ""))
    letters = T.characters(T.squeeze(F.col("text")))
    marks = F.filter(F.coalesce("marks", F.expr("CAST(array() AS ARRAY<ARRAY<DOUBLE>>)")), lambda m: F.size(m) == 2)
    plain = plain.withColumns({"letters": letters, "marks": marks})
    n = F.least(F.size("letters"), F.size("marks"))
    pair = F.arrays_zip(F.slice("letters", F.lit(1), n).alias("c"), F.slice("marks", F.lit(1), n).alias("m"))
    timed = F.transform(pair, lambda p: F.struct(p["c"].alias("text"), M.mark_to_seconds(F.get(p["m"], F.lit(0)), unit).alias("start"), M.mark_to_seconds(F.get(p["m"], F.lit(1)), unit).alias("end")))
    plain = plain.withColumn("chars", F.filter(timed, lambda c: c["end"] > c["start"]))
    some = F.size("chars") > 0
    plain = plain.select("job_id", "item", F.lit(0).alias("part"), F.when(some, F.get("chars", F.lit(0))["start"]).otherwise(0.0).alias("start"), F.when(some, F.element_at("chars", -1)["end"]).otherwise(0.001).alias("end"), "text", "chars", F.lit(None).cast("string").alias("speaker"))
    w = Window.partitionBy("job_id").orderBy("item", "part")
    k = F.row_number().over(w)
    return said.unionByName(plain).select("job_id", (k - 1).cast("long").alias("pos"), F.format_string("seg_%04d", k).alias("id"), "start", "end", "text", "chars", "speaker")


def media_info(probes: DataFrame) -> DataFrame:
    """Facts of each probe result (job_id, payload): duration, and size, rate and codecs of the first video and audio stream; null where absent."""
    v = F.try_parse_json(F.col("payload"))
    streams = F.coalesce(F.try_variant_get(v, "$.streams", "array<variant>"), F.expr("CAST(array() AS ARRAY<VARIANT>)"))
    of = lambda kind: F.get(F.filter(streams, lambda s: F.try_variant_get(s, "$.codec_type", "string") == kind), F.lit(0))
    video, audio = of("video"), of("audio")
    get = lambda s, n, kind: F.try_variant_get(s, f"$.{n}", kind)
    fps = F.coalesce(T.rate(get(video, "avg_frame_rate", "string")), T.rate(get(video, "r_frame_rate", "string")))
    return probes.select(
        "job_id", F.try_variant_get(v, "$.format.duration", "string").try_cast("double").alias("duration"), get(video, "width", "int").alias("width"), get(video, "height", "int").alias("height"),
        fps.alias("fps"), get(video, "codec_name", "string").alias("video_codec"), get(audio, "codec_name", "string").alias("audio_codec"),
    )


def subtitle_streams(probes: DataFrame) -> DataFrame:
    """Embedded subtitle streams (job_id, index, codec_name, language, title)."""
    streams = F.try_variant_get(F.try_parse_json("payload"), "$.streams", "array<variant>")
    rows = probes.select("job_id", F.explode(streams).alias("s"))
    get = lambda n, kind="string": F.try_variant_get("s", f"$.{n}", kind)
    return rows.filter(get("codec_type") == "subtitle").select("job_id", get("index", "int").alias("index"), get("codec_name").alias("codec_name"), get("tags.language").alias("language"), get("tags.title").alias("title"))


def frame_size(crop: Column) -> Column:
    """Width and height of a crop W:H:..., as a struct; null otherwise."""
    side = lambda i: F.nullif(F.regexp_extract(crop, r"^\s*(\d+):(\d+):", i), F.lit("")).cast("int")
    return F.when(side(1).isNotNull(), F.struct(side(1).alias("width"), side(2).alias("height")))
