from cueline.operators import recognition as R
from cueline.operators import windows as W
from cueline.plans import subtitles


def reader():
    class Reader:
        """Reads what the fake image says; made here so that workers need not import the test."""

        def read(self, image, mode):
            return [(image.decode(), 0.9, [])] if image else []

    return Reader


def frames(spark, texts):
    rows = []
    for i, t in enumerate(texts):
        rows.append(("j", i, i * 0.5, t.encode(), [hash_of(t), 0] if t else None))
    return spark.createDataFrame(rows, "job_id string, pos long, ts double, image binary, signature array<bigint>")


def hash_of(text):
    return sum(ord(c) << (i * 7 % 40) for i, c in enumerate(text))


TEXTS = ["", "", "第一句话", "第一句话", "第一句话", "", "", "", "", "", "", "", "", "第二句话", "第二句话", ""]


def test_chain_and_adaptive_chain(spark):
    f = frames(spark, TEXTS)
    want = [("ocr_0001", 1.0, 2.5, "第一句话"), ("ocr_0002", 6.5, 7.5, "第二句话")]
    got = subtitles.transcript_of_frames(f, reader(), interval=0.5, threshold=0, name="a").orderBy("pos").collect()
    assert [(r.id, r.start, r.end, r.text) for r in got] == want
    got = subtitles.transcript_adaptive(f, reader(), interval=0.5, threshold=0, name="b").orderBy("pos").collect()
    assert [(r.id, r.start, r.end, r.text) for r in got] == want


def test_cache_over_ranges(spark):
    rows = [("j", 0, 0, [1]), ("j", 0, 1, [1]), ("j", 0, 2, [255]), ("j", 1, 3, [1]), ("j", 1, 4, [3]), ("j", 1, 5, None), ("k", 0, 0, [1])]
    f = spark.createDataFrame([(j, r, p, float(p), s) for j, r, p, s in rows], "job_id string, range_no long, pos long, ts double, signature array<bigint>")
    plan = lambda cache: [(r.job_id, r.action, r.source_pos) for r in W.dedupe_frame_arrays(f, threshold=1, cache=cache).orderBy("job_id", "pos").collect()]
    assert plan(False) == [("j", "ocr", 0), ("j", "reused", 0), ("j", "ocr", 2), ("j", "ocr", 3), ("j", "reused", 3), ("j", "skipped", None), ("k", "ocr", 0)]
    assert plan(True) == [("j", "ocr", 0), ("j", "cached", 0), ("j", "ocr", 2), ("j", "cached", 0), ("j", "reused", 0), ("j", "skipped", None), ("k", "ocr", 0)]


def test_crops_replace_frames(spark):
    rows = [("j", 0, 0.0, [1], [7], 20), ("j", 1, 1.0, [200], [7], 20), ("j", 2, 2.0, [200], [7], 200), ("j", 3, 3.0, None, [7], 20)]
    f = spark.createDataFrame(rows, "job_id string, pos long, ts double, signature array<bigint>, crop_signature array<bigint>, crop_height int")
    got = W.dedupe_frame_arrays(f, threshold=0).orderBy("pos").collect()
    assert [(r.mode, r.action) for r in got] == [("rec_crop", "ocr"), ("rec_crop", "reused"), ("rec_frame", "ocr"), ("rec_crop", "skipped")]


def test_speech_reader(spark):
    sound = spark.createDataFrame([("j", b"x")], "job_id string, content binary")
    heard = R.read_speech(sound, lambda: lambda raw: '[{"text": "你好", "timestamp": [[0,240],[240,500]]}]')
    assert [(r.id, r.end) for r in R.speech_segments(heard).collect()] == [("seg_0001", 0.5)]


def test_jobs_of_folders_stay_apart(spark, tmp_path):
    from cueline.sources import tables

    for job in ("a b", "c"):
        (tmp_path / "runs" / job).mkdir(parents=True)
        (tmp_path / "runs" / job / "transcript.json").write_text('{"source": "%s.mp4", "segments": [{"id": "s", "start": 0, "end": 1, "text": "x"}]}' % job, encoding="utf-8")
    (tmp_path / "runs" / "c" / "own.json").write_text('{"segments": [{"id": "s", "start": 0, "end": 1, "text": "x"}]}', encoding="utf-8")
    rows = tables.read_table(spark, f"{tmp_path}/runs/*/*.json", "transcript").select("job_id", "source").collect()
    assert sorted(map(tuple, rows), key=repr) == [("a b", "a b.mp4"), ("c", "c.mp4"), ("own", None)]


def test_frames_of_a_failed_tool_raise(monkeypatch, tmp_path):
    import pytest
    from cueline.sources import media

    tool = tmp_path / "tool"
    monkeypatch.setattr(media, "_tool", lambda name: str(tool))
    for script, frames, error in (("head -c 24 /dev/zero", 2, None), ("head -c 30 /dev/zero", 2, "6 of 12"), ("head -c 12 /dev/zero; echo no such stream >&2; exit 3", 1, "no such stream")):
        tool.write_text(f"#!/bin/sh\n{script}\n")
        tool.chmod(0o755)
        got = []
        if error:
            with pytest.raises(media.MediaError, match=error):
                got.extend(media.iter_frames("v", width=2, height=2, fps=1))
        else:
            got.extend(media.iter_frames("v", width=2, height=2, fps=1, start=12345.678))
    assert media._slice(12345.678, 1e6) == ["-ss", "12345.678", "-t", "1000000.000"]


def test_replies_that_are_lists_are_no_objects(spark):
    from cueline.functions import text as T
    from pyspark.sql import functions as F

    replies = ['[{"a":1}]', '{"a":1}', 'say {"a":1} end', "```json\n{\"a\":1}\n```", "not json", ""]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    assert [r[1] for r in rows.select("i", T.json_object(F.col("r"))).orderBy("i").collect()] == [None, '{"a":1}', '{"a":1}', '{"a":1}', None, None]
