import json

import numpy as np
import pytest
from cueline import schema
from cueline.operators import recognition as R
from cueline.operators import samples as S
from cueline.operators import sentences as N
from cueline.operators import timeline as L
from cueline.operators import windows as W
from cueline.sources import media, tables
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

CHARS = "array<struct<text: string, start: double, end: double>>"


def samples(spark, rows):
    return spark.createDataFrame([("j", i, float(t), s, float(p)) for i, (t, s, p) in enumerate(rows)], "job_id string, pos long, ts double, text string, score double")


MONKEY = "我看你相貌举止像个"


@pytest.mark.parametrize(
    "rows,interval,want",
    [
        ([(0, "第一句", 0.9), (1, "第一句", 0.8), (2, "", 0), (3, "第二句", 0.95)], 1, [(0, 2, "第一句"), (3, 4, "第二句")]),
        ([(0, "下界是何声响", 0.99), (0.5, "C下界是何声响", 0.9), (1, "下界是何声响", 0.99)], 0.5, [(0, 1.5, "下界是何声响")]),
        ([(0, "它来啦它来啦", 0.99), (1, "官来啦它来啦", 0.9)], 1, [(0, 2, "它来啦它来啦")]),
        ([(0, MONKEY + "糊狱", 0.88), (1, MONKEY + "糊狲", 0.92), (2, MONKEY + "糊狲", 0.93)], 1, [(0, 3, MONKEY + "糊狱")]),
        ([(0, MONKEY + "糊狱", 0.88), (1, MONKEY + "猢孙", 0.9), (2, MONKEY + "糊狲", 0.93), (3, MONKEY + "糊狲", 0.93)], 1, [(0, 4, MONKEY + "糊狲")]),
        ([(0, "去吧", 0.95), (1, "去吧", 0.95), (2, "来吧", 0.95), (3, "来吧", 0.95)], 1, [(0, 2, "去吧"), (2, 4, "来吧")]),
        ([(0, "糊狲", 0.95), (1, "糊狲", 0.95), (2, "", 0), (3, "猢孙", 0.95), (4, "猢孙", 0.95)], 1, [(0, 2, "糊狲"), (3, 5, "猢孙")]),
    ],
)
def test_merge_samples(spark, rows, interval, want):
    got = S.merge_samples(samples(spark, rows), interval=interval).orderBy("pos").collect()
    assert [(r.start, r.end, r.text) for r in got] == want


def test_presence_ranges(spark):
    df = spark.createDataFrame([("j", float(t), h) for t, h in ((0, False), (1, True), (2, True), (6, True), (9, False))], "job_id string, ts double, has_subtitle boolean")
    got = W.presence_ranges(df, interval=1.0, max_gap=1.5, expand=1.0, start_bound=0.0, end_bound=10.0).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 4), (5, 8)]


def test_ranges_touch_and_frames(spark):
    r = spark.createDataFrame([("j", 0.0, 2.0), ("j", 2.0, 3.0), ("j", 5.0, 9.0), ("j", 6.0, 7.0), ("k", 0.0, 1.0)], "job_id string, start double, end double")
    merged = W.coalesce_ranges(r)
    assert sorted(map(tuple, merged.collect())) == [("j", 0, 3), ("j", 5, 9), ("k", 0, 1)]
    f = spark.createDataFrame([("j", float(t)) for t in range(11)] + [("k", 1.0)], "job_id string, ts double")
    for cell in (None, 2.0):
        assert sorted(x.ts for x in W.frames_in_ranges(f, merged, cell=cell).collect()) == [0, 1, 2, 5, 6, 7, 8]


def test_dedupe_and_backfill(spark):
    rows = [("j", i, float(i), s) for i, s in enumerate([[0], [1], [3], [255], None, [255], [254]])]
    f = spark.createDataFrame(rows, "job_id string, pos long, ts double, signature array<bigint>")
    planned = W.dedupe_frames(f, threshold=1)
    got = planned.orderBy("pos").collect()
    assert [(r.action, r.source_pos) for r in got] == [("ocr", 0), ("reused", 0), ("reused", 0), ("ocr", 3), ("skipped", None), ("ocr", 5), ("reused", 5)]
    read = spark.createDataFrame([("j", 0, "a", 0.5), ("j", 5, "b", 0.6)], "job_id string, pos long, text string, score double")
    assert [r.text for r in W.backfill(planned, read).orderBy("pos").collect()] == ["a", "a", "a", "", "", "b", "b"]
    assert W.dedupe_stats(planned).first().asDict() == {"job_id": "j", "ocr": 3, "skipped": 1, "reused": 3, "cached": 0}


def test_best_text(spark):
    rows = [("j", 0, 0.0, 0, "CCTV8", 0.99), ("j", 0, 0.0, 1, "不中听 不 中听", 0.95), ("j", 1, 1.0, 0, "x", 0.9)]
    got = W.best_text(spark.createDataFrame(rows, "job_id string, pos long, ts double, idx int, text string, score double")).orderBy("pos").collect()
    assert [(r.text, r.score) for r in got] == [("不中听不中听", 0.95), ("", 0)]


def credit_rows(spark, rows):
    return spark.createDataFrame([("j", i, float(a), float(b), t, 0.9) for i, (a, b, t) in enumerate(rows)], "job_id string, pos long, start double, end double, text string, score double")


def test_credits(spark):
    song = ["你挑着担我牵着马", "迎来日出送走晚霞", "踏平坎坷成大道", "斗罢艰险又出发", "啦啦啦", "敢问路在何方", "路在脚下", "一番番春秋冬夏"]
    tail = [(0, 4, "师父")] + [(100 + 4 * i, 103 + 4 * i, t) for i, t in enumerate(song)]
    assert [r.text for r in S.drop_trailing_credits(credit_rows(spark, tail)).collect()] == ["师父"]
    inline = [(4 * i, 4 * i + 3, t) for i, t in enumerate(["师父", "敢问路在何方", "走吧", "好的", "去"])]
    assert S.drop_trailing_credits(credit_rows(spark, inline)).count() == 5
    words = [(0, 2, "走吧")] + [(50 + 3 * i, 52 + 3 * i, t) for i, t in enumerate(["导演张三", "摄影李四", "剪辑王五", "出品人"])]
    assert S.drop_trailing_credits(credit_rows(spark, words), min_rows=3, min_duration=6).count() == 1


def segments(spark, rows):
    return spark.createDataFrame([("j", i, f"seg_{i + 1:03d}", float(a), float(b), t, c, None) for i, (a, b, t, c) in enumerate(rows)], f"job_id string, pos long, id string, start double, end double, text string, chars {CHARS}, speaker string")


def test_sentence_index(spark):
    got = N.sentence_index(segments(spark, [(0, 1, "第一句。", []), (1.5, 3, "第二句。", [])])).orderBy("pos").collect()
    assert [(r.id, r.pause_after) for r in got] == [("S0001", 0.5), ("S0002", 0)]


def test_timed_characters(spark):
    timed = [("第", 0.0, 0.2), ("一", 0.2, 0.4), ("句", 0.4, 0.6), ("。", 0.6, 0.8), ("第", 2.0, 2.2), ("二", 2.2, 2.4), ("句", 2.4, 2.6), ("。", 2.6, 2.8)]
    got = N.sentence_index(segments(spark, [(0, 4, "第一句。第二句。", timed)])).orderBy("pos").collect()
    assert [(r.start, r.end, r.pause_after) for r in got] == [(0, 0.8, 1.2), (2, 2.8, 0)]
    bare = [("你", 0.0, 0.2), ("好", 0.2, 0.4), ("世", 0.5, 0.7), ("界", 0.7, 0.9), ("继", 2.0, 2.2), ("续", 2.2, 2.4)]
    got = N.sentence_index(segments(spark, [(0, 4, "你好，世界。继续。", bare)])).orderBy("pos").collect()
    assert [(r.text, r.start, r.end) for r in got] == [("你好，世界。", 0, 0.9), ("继续。", 2, 2.4)]


def test_untimed_parts_share_the_time(spark):
    got = N.split_segments(segments(spark, [(0, 10, "一二三。四。", []), (10, 11, " ", []), (11, 12, "。。", [])])).orderBy("pos").collect()
    assert [(r.text, round(r.start, 6), round(r.end, 6)) for r in got] == [("一二三。", 0, 6.666667), ("四。", 6.666667, 10), ("。。", 11, 12)]


def index(spark, rows):
    return spark.createDataFrame([("j", i, f"S{i + 1:04d}", float(a), float(b), t, None, float(p)) for i, (a, b, t, p) in enumerate(rows)], "job_id string, pos long, id string, start double, end double, text string, speaker string, pause_after double")


def test_topic_blocks(spark):
    rows = index(spark, [(0, 10, "a", 0), (10, 20, "b", 0), (20, 40, "c", 0)])
    got = N.topic_blocks(rows, min_duration=5, max_duration=25).orderBy("pos").collect()
    assert [(r.id, r.start_sentence_id, r.end_sentence_id, r.sentence_count) for r in got] == [("B0001", "S0001", "S0002", 2), ("B0002", "S0003", "S0003", 1)]
    pause = index(spark, [(0, 21, "a", 1.2), (23, 24, "b", 0.1), (24, 46, "c", 0), (46, 47, "最后d", 0)])
    assert [r.text for r in N.topic_blocks(pause).orderBy("pos").collect()] == ["a", "bc", "最后d"]


def test_quality(spark):
    bad = N.quality(index(spark, [(0, 95, "嗯嗯啊啊啊啊这这这这这这这。", 0)])).first()
    assert bad.recommendation == "prefer_subtitle_or_ocr" and bad.score < 0.7 and bad.reasons[0] == "sentence_timestamps_have_large_spans"
    good = N.quality(index(spark, [(0, 4, "今天我们介绍自动化剪辑的整体流程。", 1), (5, 9, "第一步是提取音频并生成字幕。", 0)])).first()
    assert good.recommendation == "asr_usable" and good.score > 0.8 and good.reasons == []


BLOCKS = "job_id string, pos long, source string, id string, start double, end double, text string, sentence_count int, speaker string"
DECISIONS = "job_id string, pos long, block_id string, decision string, reason string, title string, confidence double"


def plan(spark):
    blocks = spark.createDataFrame([("j", 0, "v.mp4", "B0001", 0.0, 10.0, "核心内容。", 1, None), ("j", 1, "v.mp4", "B0002", 10.0, 15.0, "重复内容。", 1, None), ("j", 2, "v.mp4", "B0003", 15.0, 16.0, "x", 1, "s")], BLOCKS)
    decisions = spark.createDataFrame([("j", 0, "B0001", "keep", "核心内容", "开场", 0.9), ("j", 1, "B0002", "delete", "重复", "", 0.8)], DECISIONS)
    return blocks, decisions


def test_timeline_and_report(spark):
    blocks, decisions = plan(spark)
    t = L.plan_to_timeline(decisions, blocks)
    assert [(r.id, r.start, r.end, r.decision, r.text) for r in t.orderBy("pos").collect()] == [("B0001", 0, 10, "keep", "开场"), ("B0002", 10, 15, "delete", "重复内容。")]
    chapters = spark.createDataFrame([("j", 0, "开场", "B0001", "B0001", "")], "job_id string, pos long, title string, start_block_id string, end_block_id string, summary string")
    text = L.cut_report(spark.createDataFrame([("j", "v.mp4")], "job_id string, source string"), blocks, chapters, decisions, t).first().report
    for line in ("# Cut Report: j", "- Source: v.mp4", "- Topic blocks: 3", "- Estimated rough-cut duration: 10s", "- Removed duration: 5s", "- Keep ratio: 66.7%", "- 1 blocks have no keep/delete decision.",
                 "- 开场: B0001 -> B0001", "- B0001 | 00:00:00-00:00:10 | 10s | 开场", "  Reason: 核心内容", "  Text: 核心内容。", "## Missing Decisions", "- B0003"):
        assert line in text.split("\n")
    assert text.endswith("- B0003\n") and [line for line in text.split("\n") if line.startswith("## ")] == ["## Summary", "## Warnings", "## Chapters", "## Keep Segments", "## Delete Segments", "## Missing Decisions"]


def test_unknown_block_stops(spark):
    blocks, decisions = plan(spark)
    bad = decisions.withColumn("block_id", F.lit("B9999"))
    with pytest.raises(PySparkException, match="B9999"):
        L.plan_to_timeline(bad, blocks).collect()
    assert L.plan_to_timeline(bad, blocks, strict=False).count() == 0


def test_preview(spark):
    s = segments(spark, [(1, 3, "a", []), (5, 8, "b", []), (9, 10, "c", [])])
    t = spark.createDataFrame([("j", 0, 5.0, 7.0, "keep"), ("j", 1, 1.0, 3.0, "keep"), ("j", 2, 9.0, 10.0, "delete")], "job_id string, pos long, start double, end double, decision string")
    got = L.preview(s, t).orderBy("pos").collect()
    assert [(r.id, r.start, r.end, r.text) for r in got] == [("preview_0001", 0, 2, "a"), ("preview_0002", 2, 4, "b")]
    assert [r.start for r in L.kept(t).orderBy("keep_no").collect()] == [1, 5]


def test_rules(spark):
    t = spark.createDataFrame([("a", 2.0, 2.0, "keep", 0.5), ("b", 0.0, 1.0, "maybe", 2.0), ("c", 0.0, 1.0, "keep", None)], "id string, start double, end double, decision string, confidence double")
    good, bad = schema.quarantine(t, schema.RULES["timeline"])
    assert [r.id for r in good.collect()] == ["c"] and {r.id: len(r.broken) for r in bad.collect()} == {"a": 1, "b": 2}
    with pytest.raises(PySparkException, match="end is after start"):
        schema.validated(t.filter("id = 'a'"), schema.RULES["timeline"]).collect()


def test_files_round_trip(spark, tmp_path):
    job = {"source": "v.mp4", "language": "zh", "segments": [{"id": "s1", "start": 0, "end": 1.25, "text": "第一句。", "chars": [], "speaker": None}, {"id": "s2", "start": 1.5, "end": 3, "text": "第二句。", "chars": [{"text": "第", "start": 1.5, "end": 1.6}], "speaker": "a"}]}
    (tmp_path / "demo.json").write_text(json.dumps(job, ensure_ascii=False, indent=2), encoding="utf-8-sig")
    rows = tables.read_table(spark, str(tmp_path / "demo.json"), "transcript")
    assert [(r.job_id, r.pos, r.id, r.language) for r in rows.orderBy("pos").collect()] == [("demo", 0, "s1", "zh"), ("demo", 1, "s2", "zh")]
    out = tables.to_json(rows, "segments", {"source": F.col("source"), "language": F.col("language")}).first().json
    assert json.loads(out) == job
    assert tables.srt(rows).first().srt == "1\n00:00:00,000 --> 00:00:01,250\n第一句。\n\n2\n00:00:01,500 --> 00:00:03,000\n第二句。\n"
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="bad.json"):
        tables.read_table(spark, str(tmp_path / "bad.json"), "transcript").collect()


def test_block_list(spark):
    b = spark.createDataFrame([("j", 0, "B0001", 1.0, 2.0, "x", 1, "s"), ("j", 1, "B0002", 2.0, 3.0, "y", 2, None)], "job_id string, pos long, id string, start double, end double, text string, sentence_count int, speaker string")
    text = tables.block_list(b).first().markdown
    assert text.startswith("# Transcript Blocks For Editing\n\n") and text.endswith("```\n\n[B0001 | 00:00:01.00-00:00:02.00 | 1 sentences | spk=s]\nx\n\n[B0002 | 00:00:02.00-00:00:03.00 | 2 sentences]\ny\n")


def results(spark, payload):
    return spark.createDataFrame([("j", 0, payload)], "job_id string, pos long, payload string")


def test_recogniser_results(spark):
    assert [(r.text, r.score) for r in R.line_items(results(spark, '[{"res": {"rec_text": "第一句", "rec_score": 0.92}}, {"rec_text": ""}]')).collect()] == [("第一句", 0.92)]
    r = R.text_items(results(spark, '[{"res": {"rec_texts": ["第一句"], "rec_scores": [0.91], "rec_boxes": [[10,20,110,40]]}}]')).first()
    assert (r.text, r.score, r.box) == ("第一句", 0.91, [[10, 20], [110, 20], [110, 40], [10, 40]])
    r = R.text_items(results(spark, '{"rec_texts": ["a", "b"], "rec_scores": [0.5]}')).orderBy("idx").collect()
    assert [(x.text, x.score, x.box) for x in r] == [("a", 0.5, []), ("b", 0.0, [])]
    items = R.text_items(results(spark, '{"texts": ["a", "b"], "scores": [0.5, 0.6], "dt_polys": [[[0,0],[1,0],[1,1],[0,1]]]}'))
    assert tuple(R.best_item(items).first()) == ("j", 0, "b", 0.6)


def test_speech_results(spark):
    r = R.speech_segments(results(spark, '[{"text": "你好", "timestamp": [[0,240],[240,500]]}]').drop("pos")).first()
    assert (r.id, r.start, r.end, [c.text for c in r.chars]) == ("seg_0001", 0, 0.5, ["你", "好"])
    payload = '[{"sentence_info": [{"text": "第一句。","start":0,"end":1200,"spk":0}, {"text":"第二句。","start":1500,"end":2600,"spk":1}]}]'
    r = R.speech_segments(results(spark, payload).drop("pos")).orderBy("pos").collect()
    assert [(x.speaker, x.start, x.end) for x in r] == [("0", 0, 1.2), ("1", 1.5, 2.6)]


def test_media(spark):
    payload = json.dumps({"format": {"duration": "61.5"}, "streams": [{"codec_type": "subtitle", "index": 2, "codec_name": "srt", "tags": {"language": "zh"}}, {"codec_type": "video", "codec_name": "h264", "width": 64, "height": 48, "avg_frame_rate": "0/0", "r_frame_rate": "25/1"}]})
    assert tuple(R.media_info(results(spark, payload)).first()) == ("j", 61.5, 64, 48, 25.0, "h264", None)
    assert tuple(R.subtitle_streams(results(spark, payload)).first()) == ("j", 2, "srt", "zh", None)
    with pytest.raises(media.MediaError):
        media.render("v.mp4", [], "o.mp4", work="/tmp")


def test_reading_frames(spark):
    class Fake:
        def read(self, image, mode):
            return [(image.decode(), 0.9, [[0.0, 0.0]])] if image else []

    frames = spark.createDataFrame([("j", 0, 0.0, b"ab", "full"), ("j", 1, 1.0, b"", "full")], "job_id string, pos long, ts double, image binary, mode string")
    assert [tuple(r) for r in R.read_frames(frames, Fake).collect()] == [("j", 0, 0.0, 0, "ab", 0.9, [[0.0, 0.0]])]
    assert R.check_engine(" RapidOCR ") == "rapidocr"
    for bad in (("x", None), ("ppocrv6", "huge")):
        with pytest.raises(ValueError):
            R.check_engine(*bad)


def test_image_kernels(spark):
    frame = np.zeros((60, 200, 3), np.uint8)
    assert media.frame_signature(frame) is None and media.subtitle_box(frame) is None
    frame[30:40, 60:90] = frame[30:40, 100:120] = 255
    frame[2:4, 60:90] = 255  # at the top border
    frame[50, 100] = 255  # a speck
    assert media.subtitle_box(frame) == (58, 28, 122, 42)
    sig = media.frame_signature(frame)
    assert len(sig) == 16 and any(sig)
    frame[..., 0] = 0  # yellow is saturated
    assert media.frame_signature(frame) is None
    rows = spark.createDataFrame([(bytearray(np.full((16, 64, 3), 255, np.uint8).tobytes()), 16, 64)], "f binary, h int, w int")
    assert rows.select(media.signature_of("f", "h", "w"), media.box_of("f", "h", "w")).first() == ([-1] * 16, None)
