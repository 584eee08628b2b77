import random

import pytest
from cueline import queries
from cueline.functions import text as T
from cueline.functions import time as M
from pyspark.sql import functions as F


def col(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("seconds,want", [(0.0, "00:00:00,000"), (65.4321, "00:01:05,432"), (3661.9996, "01:01:02,000"), (360000.5, "100:00:00,500")])
def test_srt_time(spark, seconds, want):
    assert col(spark, seconds, "double", M.srt_time) == want
    assert col(spark, seconds, "double", M.clock_time) == want[:-4]
    assert col(spark, seconds, "double", M.compact_time) == want.replace(",", ".")[:-1]


@pytest.mark.parametrize("seconds,want", [(0.5, "0s"), (1.5, "2s"), (-3.0, "0s"), (59.6, "1m 0s"), (3723.0, "1h 2m 3s"), (2.5, "2s")])
def test_duration(spark, seconds, want):
    assert col(spark, seconds, "double", M.duration_text) == want


def test_percent_is_half_even(spark):
    assert col(spark, 0.0025, "double", M.percent_text) == "0.2%" and col(spark, 2 / 3, "double", M.percent_text) == "66.7%"


def test_marks(spark):
    assert [col(spark, v, "double", M.mark_to_seconds) for v in (240.0, 100.0, None, -500.0)] == [0.24, 100.0, 0.0, -0.5]


@pytest.mark.parametrize("text,want", [("真的?!好", ["真的?", "好"]), ("a.b", ["a.b"]), ("。。", []), ("一。二！三", ["一。", "二！", "三"])])
def test_sentence_parts(spark, text, want):
    assert col(spark, text, "string", T.sentence_parts) == want


def test_normal_forms(spark):
    assert col(spark, " a　b\x1cc  ", "string", T.squeeze) == "abc"
    assert col(spark, "《不中听 不 中听》…", "string", T.subtitle_text) == "不中听不中听"
    assert col(spark, "  demo video: 01/02?*  ", "string", T.job_name) == "demo_video_01_02"
    assert col(spark, " ?? ", "string", T.job_name) == "default"
    assert col(spark, "x " * 60, "string", T.preview) == ("x " * 40).rstrip() + "..."


def test_subtitle_likeness_and_openers(spark):
    assert [col(spark, t, "string", T.looks_like_subtitle) for t in ("CCTV8", "好", "你好", "看BiliBili吧")] == [False, False, True, False]
    assert [col(spark, t, "string", T.opens_section) for t in ("首先说", "我首先")] == [True, False]


def test_quality_parts(spark):
    assert col(spark, "嗯 嗯好x", "string", T.noise_share) == 0.5 and col(spark, " ", "string", T.noise_share) == 0
    assert col(spark, "好。x", "string", T.han_share) == 0.5
    assert col(spark, "啊啊啊啊啊这这这这好好", "string", T.repeated_runs) == 2


def pair(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]


def test_pairs(spark):
    assert pair(spark, "abc", "abd", T.hamming) == 1 and pair(spark, "ab", "abc", T.hamming) is None
    assert pair(spark, "下界", "C下界", T.stable_text) == "下界" and pair(spark, "它来啦", "官来啦", T.stable_text) == "它来啦"
    assert pair(spark, "去吧", "来吧", T.short_han_substitution) is True and pair(spark, "ab", "cb", T.short_han_substitution) is False
    assert pair(spark, "我看你相貌举止", "我看你相貌举x", T.reading_jitter) is False
    assert pair(spark, "12345678", "12345xy8", T.reading_jitter) is True


def test_hamming_against_python(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ab漢😀") for _ in range(n)), "".join(rng.choice("ab漢😀") for _ in range(n))) for n in range(12)]
    got = spark.createDataFrame(rows, "a string, b string").select(T.hamming(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [sum(x != y for x, y in zip(a, b)) for a, b in rows]


def test_credit_signal(spark):
    assert [col(spark, t, "string", T.credit_signal) for t in ("导演 张三", "敢问路在何方路在脚下", "啦啦啦", "今天")] == [2, 2, 1, 0]


@pytest.mark.parametrize("content,want", [('x\n```json\n{"a": 1}\n```', '{"a": 1}'), ('{"a": [2]}', '{"a": [2]}'), ('so {"a": {"b": 1}} ok', '{"a": {"b": 1}}'), ("not json", None), ("[1]", None)])
def test_json_object(spark, content, want):
    assert col(spark, content, "string", T.json_object) == want


def test_rates_and_boxes(spark):
    assert [col(spark, v, "string", T.rate) for v in ("30000/1001", "25", "1/0", "x", None)] == [30000 / 1001, 25.0, None, None, None]
    assert col(spark, [10.0, 20.0, 110.0, 40.0], "array<double>", T.corner_points) == [[10, 20], [110, 20], [110, 40], [10, 40]]


def test_signature_distance(spark):
    df = spark.createDataFrame([([1, -1], [3, 0]), ([1], [1, 2]), (None, [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(T.signature_distance(F.col("a"), F.col("b"))).collect()] == [65, None, None]


def test_srt_time_format_over_the_whole_table(spark, tmp_path):
    n = [0, 1, 500, 1500, 2500, 61_500, 3_700_500]
    spark.createDataFrame(list(enumerate(n)), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.srt, r.duration) for r in queries.srt_time_format(spark, str(tmp_path)).collect()}
    assert len(got) == len(n)
    for i, c in enumerate(n):
        ms, s = c * 977, round(c * 977 / 1000)  # Python rounds half to even
        parts = ((s // 3600, "h"), (s // 60 % 60, "m"), (s % 60, "s"))
        want = " ".join(f"{v}{u}" for k, (v, u) in enumerate(parts) if s >= (3600, 60, 0)[k])
        assert got[i] == (f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}", want)
