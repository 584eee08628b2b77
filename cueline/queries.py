"""The library's queries over the driver tables, and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline import views as V
from cueline.functions import text as T
from cueline.functions import time as M
from cueline.operators import recognition as R
from cueline.operators import samples as S
from cueline.operators import sentences as N
from cueline.operators import timeline as L
from cueline.operators import windows as W
from cueline.sources import tables as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_blocks(spark, sf_dir)


_MS = "printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000)"


@query(f"""SELECT doc_id, {_MS} AS srt, replace(left({_MS}, 11), ',', '.') AS compact, left({_MS}, 8) AS clock,
    CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, (s // 60) % 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration
    FROM (SELECT doc_id, n_chars * 977 AS ms, (n_chars * 977 // 1000 + CASE WHEN n_chars * 977 % 1000 > 500 OR n_chars * 977 % 1000 = 500 AND n_chars * 977 // 1000 % 2 = 1 THEN 1 ELSE 0 END) AS s FROM documents)""")
def srt_time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 977).alias("ms"))
    s = F.col("ms") / 1000
    return d.select("doc_id", M.srt_time(s).alias("srt"), M.compact_time(s).alias("compact"), M.clock_time(s).alias("clock"), M.duration_text(s).alias("duration"))


_SQUEEZE = r"regexp_replace(text, '[\s\x0b\x1c-\x1f]+', '', 'g')"
_PARTS = f"""parts AS (SELECT job_id, pos, id, start_, end_, speaker, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT *, CASE WHEN len(q) = 0 THEN [t] ELSE q END AS p
    FROM (SELECT *, regexp_extract_all(t, '[^。！？!?；;]+[。！？!?；;]?') AS q FROM (SELECT *, {_SQUEEZE} AS t FROM segments) WHERE t <> ''))),
    timed AS (SELECT *, list_sum(list_transform(p, lambda x: length(x))) AS size, coalesce(list_sum(list_transform(p[1:k - 1], lambda x: length(x))), 0) AS before FROM parts),
    split AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY pos, k) - 1 AS pos, id AS source_segment_id, speaker, p[k] AS text,
        CASE WHEN k = 1 THEN start_::DOUBLE ELSE start_ + (end_ - start_) * before / size END AS a, CASE WHEN k = len(p) THEN end_::DOUBLE ELSE start_ + (end_ - start_) * (before + length(p[k])) / size END AS b FROM timed)"""


@query(V.with_views("segments") + "," + _PARTS + " SELECT job_id, pos, source_segment_id, speaker, text, floor(a + 0.123)::BIGINT AS start_ms, floor(b + 0.123)::BIGINT AS end_ms FROM split")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.floor(F.col(c) + 0.123).cast("long").alias(f"{c}_ms")
    rows = N.split_segments(V.segments(spark, sf_dir), timed=False)
    return rows.select("job_id", "pos", "source_segment_id", "speaker", "text", ms("start"), ms("end"))


@query(V.with_views("segments", "sentences") + " SELECT job_id, pos, id, pause AS pause_ms FROM sentences")
def sentence_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sentences(spark, sf_dir).select("job_id", "pos", "id", F.col("pause_after").cast("long").alias("pause_ms"))


_RULE = {"min_duration": 20_000, "max_duration": 60_000, "split_pause": 1200}
_BLOCKS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS n, regexp_matches(text, '^(首先|第一|第二|第三|第四|第五|接下来|然后|最后|总结|下面|我们来看|另一个)') AS opens FROM sentences),
    fold AS (SELECT job_id, n, 1 AS block_no, start_ AS first, end_ AS last_end, pause AS last_pause FROM numbered WHERE n = 1
        UNION ALL SELECT s.job_id, s.n, f.block_no + c.new, CASE WHEN c.new = 1 THEN s.start_ ELSE f.first END, s.end_, s.pause
        FROM fold f JOIN numbered s ON s.job_id = f.job_id AND s.n = f.n + 1
        CROSS JOIN LATERAL (SELECT CASE WHEN f.last_end - f.first >= 20000 AND f.last_pause >= 1200 OR s.end_ - f.first > 60000 OR f.last_end - f.first >= 20000 AND s.opens THEN 1 ELSE 0 END AS new) c),
    made AS (SELECT s.job_id, f.block_no, arg_min(s.id, s.n) AS start_sentence_id, arg_max(s.id, s.n) AS end_sentence_id, min(s.start_) AS start_ms, arg_max(s.end_, s.n) AS end_ms, string_agg(s.text, '' ORDER BY s.n) AS text,
        count(*)::INT AS sentence_count, CASE WHEN count(DISTINCT nullif(speaker, '')) = 1 THEN max(nullif(speaker, '')) END AS speaker FROM numbered s JOIN fold f ON f.job_id = s.job_id AND f.n = s.n GROUP BY s.job_id, f.block_no)"""


@query(V.with_views("segments", "sentences") + "," + _BLOCKS + " SELECT job_id, block_no - 1 AS pos, printf('B%04d', block_no) AS id, start_sentence_id, end_sentence_id, start_ms, end_ms, text, sentence_count, speaker FROM made")
def topic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = N.topic_blocks(V.sentences(spark, sf_dir), **_RULE)
    return b.select("job_id", "pos", "id", "start_sentence_id", "end_sentence_id", "start", "end", "text", "sentence_count", "speaker")


@query("SELECT conv_id AS job_id, CASE WHEN count(DISTINCT nullif(role, '')) = 1 THEN max(nullif(role, '')) END AS speaker FROM conversations GROUP BY conv_id")
def speaker_of_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(spark, sf_dir).groupBy("job_id").agg(N.speaker_of().alias("speaker"))


_QUALITY = f"""whole AS (SELECT job_id, count(*) AS n, max(end_) - min(start_) AS duration, max(end_ - start_) AS longest, count(*) FILTER (WHERE end_ - start_ > 30000) AS long, string_agg(text, '' ORDER BY pos) AS text FROM segments GROUP BY job_id),
    letters AS (SELECT job_id, i, text[i] AS c FROM (SELECT job_id, text, unnest(range(1, length(text) + 1)) AS i FROM whole)),
    runs AS (SELECT job_id, count(*) FILTER (WHERE len >= 4) AS runs FROM (SELECT job_id, c, i - r AS g, count(*) AS len FROM (SELECT *, row_number() OVER (PARTITION BY job_id, c ORDER BY i) AS r FROM letters WHERE c <> chr(10)) GROUP BY job_id, c, g) GROUP BY job_id),
    told AS (SELECT w.*, coalesce(runs, 0) AS runs, {_SQUEEZE} AS t FROM whole w LEFT JOIN runs USING (job_id)),
    rated AS (SELECT *, CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^嗯啊唉呃额哦哈]', '', 'g')) / length(t) ELSE 0 END AS noise,
        coalesce(length(regexp_replace(t, '[^一-鿿]', '', 'g')) / nullif(length(regexp_replace(t, '[。；！？!?;、：:，,.…“”"''（）()《》]', '', 'g')), 0), 0) AS han FROM told)"""


@query(V.with_views("segments") + "," + _QUALITY + """ SELECT job_id, n AS sentence_count, duration AS duration_ms, longest AS max_sentence_ms, long AS long_sentence_count, runs AS repeated_runs, round(noise * 1e6)::BIGINT AS noise_ppm,
    round(han * 1e6)::BIGINT AS han_ppm, round(1000 * greatest(0, 1 - (least(0.35, 0.035 * long) + least(0.25, 1.2 * noise) + CASE WHEN han < 0.55 THEN 0.2 ELSE 0 END + least(0.15, 0.01 * runs) + CASE WHEN longest > 90000 THEN 0.15 ELSE 0 END)))::BIGINT AS score_milli FROM rated""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = N.quality(V.segments(spark, sf_dir), second=1000, rounded=False)
    part = lambda c, of: F.round(F.col(c) * of).cast("long")
    return q.select(
        "job_id", "sentence_count", part("duration", 1000).alias("duration_ms"), part("max_sentence_duration", 1000).alias("max_sentence_ms"), "long_sentence_count", F.col("repeated_char_run_count").cast("long").alias("repeated_runs"),
        part("noise_token_ratio", 1e6).alias("noise_ppm"), part("chinese_char_ratio", 1e6).alias("han_ppm"), part("score", 1000).alias("score_milli"),
    )


_FRAMES = """fr AS (SELECT label AS job_id, vec_id AS pos, vec_id * 40 AS ts, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
    far AS (SELECT *, lag(s) OVER (PARTITION BY job_id ORDER BY pos) AS p FROM fr),
    marked AS (SELECT job_id, pos, ts, CASE WHEN p IS NULL OR len(list_filter(range(1, 65), lambda i: s[i] <> p[i])) > 28 THEN 1 ELSE 0 END AS new FROM far),
    isl AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY pos) AS g FROM marked),
    planned AS (SELECT job_id, pos, ts, CASE WHEN new = 1 THEN 'ocr' ELSE 'reused' END AS action, min(pos) OVER (PARTITION BY job_id, g) AS source_pos FROM isl)"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dedupe_frames(V.frames(spark, sf_dir), threshold=28)


@query(f"WITH {_FRAMES} SELECT * FROM planned")
def frame_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("job_id", "pos", "ts", "action", "source_pos")


@query(f"WITH {_FRAMES} SELECT job_id, pos, ts::DOUBLE AS ts, action, source_pos FROM planned")
def frame_array_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dedupe_frame_arrays(V.frames(spark, sf_dir), threshold=28).select("job_id", "pos", "ts", "action", "source_pos")


@query(f"WITH {_FRAMES} SELECT job_id, pos, ts, 'text ' || source_pos AS text, source_pos % 10 / 10 AS score FROM planned")
def frame_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _planned(spark, sf_dir)
    read = planned.filter("action = 'ocr'").select("job_id", "pos", F.concat(F.lit("text "), F.col("pos").cast("string")).alias("text"), (F.col("pos") % 10 / 10).alias("score"))
    return W.backfill(planned, read)


@query(f"WITH {_FRAMES} SELECT job_id, count(*) FILTER (WHERE action = 'ocr') AS ocr, 0::BIGINT AS skipped, count(*) FILTER (WHERE action = 'reused') AS reused, 0::BIGINT AS cached FROM planned GROUP BY job_id")
def dedupe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dedupe_stats(_planned(spark, sf_dir))


def _coalesced(source: str, out: str) -> str:
    return f"""{out} AS (SELECT job_id, min(start_) AS start_, max(end_) AS end_ FROM (SELECT *, sum(o) OVER (PARTITION BY job_id ORDER BY start_, end_ ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN start_ > max(end_) OVER (PARTITION BY job_id ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM {source})) GROUP BY job_id, g)"""


_RANGES = f"""hits AS (SELECT job_id, ts, CASE WHEN ts - (lag(ts) OVER (PARTITION BY job_id ORDER BY ts) + 3600000) <= 5400000 THEN 0 ELSE 1 END AS new FROM ev WHERE event_type <> 'error'),
    runs AS (SELECT job_id, greatest(0, min(ts) - 600000) AS start_, max(ts) + 4200000 AS end_ FROM (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM hits) GROUP BY job_id, g),
    {_coalesced("runs", "ranges")}"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda n: F.lit(n).cast("long")
    return W.presence_ranges(V.detections(spark, sf_dir), interval=long(V.HOUR), max_gap=long(5_400_000), expand=long(600_000), start_bound=long(0), digits=None)


@query(V.with_views("ev") + "," + _RANGES + " SELECT job_id, start_ AS start_ms, end_ AS end_ms FROM ranges")
def subtitle_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("job_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


@query(V.with_views("ev") + f", raw AS (SELECT job_id, ts AS start_, ts + floor(value)::BIGINT * 600000 AS end_ FROM ev), {_coalesced('raw', 'ranges')} SELECT job_id, start_ AS start_ms, end_ AS end_ms FROM ranges")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.events(spark, sf_dir).select("job_id", F.col("ts").alias("start"), (F.col("ts") + F.floor("value").cast("long") * 600_000).alias("end"))
    return W.coalesce_ranges(raw).select("job_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


@query(V.with_views("ev") + "," + _RANGES + " SELECT e.job_id, e.event_id, e.ts FROM ev e WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM ranges r WHERE r.job_id = e.job_id AND e.ts >= r.start_ AND e.ts < r.end_)")
def frames_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = V.events(spark, sf_dir).filter("event_type = 'error'").select("job_id", "event_id", "ts")
    return W.frames_in_ranges(frames, _ranges(spark, sf_dir), cell=24 * V.HOUR)


_STRIP = "trim(" + _SQUEEZE + ", '。！？!?；;，,、：:,.…“”\"''（）()《》|· ')"


@query(f"""WITH rows AS (SELECT conv_id AS job_id, turn // 3 AS pos, turn % 3 AS idx, {_STRIP} AS text, (length(text) % 100) / 100 AS score FROM conversations),
    good AS (SELECT *, score >= 0.3 AND length(text) >= 2 AND NOT regexp_matches(lower(text), 'cctv|bilibili|bibi|电视剧') AS ok FROM rows)
    SELECT job_id, pos, pos * 40 AS ts, coalesce(arg_max(text, (score, length(text), -idx)) FILTER (WHERE ok), '') AS text, coalesce(max(score) FILTER (WHERE ok), 0) AS score FROM good GROUP BY job_id, pos""")
def best_text_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.table(spark, sf_dir, "conversations")
    frame = F.floor(F.col("turn") / 3).cast("long")
    rows = t.select(F.col("conv_id").alias("job_id"), frame.alias("pos"), (frame * 40).alias("ts"), (F.col("turn") % 3).alias("idx"), "text", (F.length("text") % 100 / 100).alias("score"))
    return W.best_text(rows, min_score=0.3)


_STRETCHES = f"""cut AS (SELECT job_id, pos, ts, {_STRIP} AS text, score FROM samples),
    stretches AS (SELECT *, sum(c) OVER (PARTITION BY job_id ORDER BY ts, pos ROWS UNBOUNDED PRECEDING) AS stretch FROM (SELECT *, CASE WHEN text = '' OR coalesce(lag(text) OVER w, '') = '' OR ts - (lag(ts) OVER w + 3600000) > 18000000 THEN 1 ELSE 0 END AS c
        FROM cut WINDOW w AS (PARTITION BY job_id ORDER BY ts, pos)))"""


@query(V.with_views("ev", "samples") + "," + _STRETCHES + " SELECT job_id, pos, ts, text, score, stretch::BIGINT AS stretch FROM stretches WHERE text <> ''")
def sample_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hard_stretches(V.samples(spark, sf_dir), gap_limit=5 * V.HOUR, interval=V.HOUR)


@query(V.with_views("ev", "samples") + "," + _STRETCHES + """ SELECT job_id, stretch::BIGINT AS stretch, event::BIGINT AS event, min(ts) AS first_ts, max(ts) AS last_ts, max(text) AS text, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY job_id, stretch ORDER BY ts, pos ROWS UNBOUNDED PRECEDING) AS event
    FROM (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY job_id, stretch ORDER BY ts, pos) = text THEN 0 ELSE 1 END AS new FROM stretches WHERE text <> '')) GROUP BY job_id, stretch, event""")
def subtitle_events_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exact_events(V.samples(spark, sf_dir), interval=V.HOUR, gap_limit=5 * V.HOUR)


@query()
def subtitle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = V.samples(spark, sf_dir).withColumn("ts", F.col("ts") / 1000)
    return S.merge_samples(samples, interval=3600.0, max_gap=5 * 3600.0)


@query("""WITH t AS (SELECT user_id AS job_id, event_id // 50 AS event, event_type AS text, count(*) AS n, sum(floor(value)) AS total, min(event_id) AS first_pos FROM events GROUP BY 1, 2, 3)
    SELECT job_id, event, arg_max(text, (n, total, -first_pos)) AS text, max(n) AS votes, count(*) AS readings FROM t GROUP BY job_id, event""")
def event_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    return S.event_votes(e.select("job_id", F.floor(F.col("event_id") / 50).cast("long").alias("event"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"), F.floor("value").cast("double").alias("score")))


_WORDS, _LINES = ("thing", "tionque"), ("ofthe", "andthe", "ingof", "dela")


@query(V.with_views("segments") + f""", s AS (SELECT *, {_STRIP} AS t, CASE WHEN lead(start_) OVER (PARTITION BY job_id ORDER BY pos) - end_ > 1000 THEN 1 ELSE 0 END AS c FROM segments),
    m AS (SELECT *, sum(c) OVER (PARTITION BY job_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) = 0 AS tail, {" + ".join(f"contains(t, '{x}')::INT" for x in _LINES)} AS songs FROM s),
    g AS (SELECT *, CASE WHEN {" OR ".join(f"contains(t, '{x}')" for x in _WORDS)} THEN 2 ELSE 0 END + songs + CASE WHEN contains(t, '啦') AND length(t) <= 6 THEN 1 ELSE 0 END AS signal FROM m),
    e AS (SELECT job_id, count(*) AS n, arg_min(signal, pos) AS first, arg_max(end_, pos) - arg_min(start_, pos) AS span, count(*) FILTER (WHERE signal > 0) AS signals, count(*) FILTER (WHERE signal >= 2) AS strong, count(*) FILTER (WHERE songs > 0) AS sung,
        max(end_) FILTER (WHERE songs > 0) - min(start_) FILTER (WHERE songs > 0) AS songspan FROM g WHERE tail GROUP BY job_id),
    gone AS (SELECT job_id FROM e WHERE n >= 2 AND first > 0 AND span >= 4000 AND (strong >= 2 AND signals >= greatest(3, n // 3) OR n >= 6 AND sung >= 4 AND songspan >= 12))
    SELECT job_id, pos, id, start_ AS start_ms, end_ AS end_ms FROM g WHERE NOT (tail AND job_id IN (SELECT job_id FROM gone))""")
def trailing_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.drop_trailing_credits(V.segments(spark, sf_dir), max_gap=1000, min_rows=2, min_duration=4000, words=_WORDS, lines=_LINES)
    return kept.select("job_id", "pos", "id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.plan_to_timeline(V.decisions(spark, sf_dir), V.blocks(spark, sf_dir))


@query(V.with_views("blocks", "decisions", "timeline") + " SELECT job_id, pos, id, start_ AS start_ms, end_ AS end_ms, decision, text, confidence::DOUBLE AS confidence FROM timeline")
def timeline_from_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).drop("reason").withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


@query(V.with_views("blocks", "decisions") + " SELECT job_id, pos, id FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE d.job_id = b.job_id AND d.block_id = b.id)")
def missing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing_decisions(V.blocks(spark, sf_dir), V.decisions(spark, sf_dir)).select("job_id", "pos", "id")


@query(V.with_views("blocks", "decisions", "timeline") + """, t AS (SELECT job_id, count(*) FILTER (WHERE decision = 'keep') AS keep_segments, count(*) FILTER (WHERE decision = 'delete') AS delete_segments,
    coalesce(sum(end_ - start_) FILTER (WHERE decision = 'keep'), 0)::BIGINT AS keep_duration, coalesce(sum(end_ - start_) FILTER (WHERE decision = 'delete'), 0)::BIGINT AS delete_duration, count(*) AS decisions FROM timeline GROUP BY job_id)
    SELECT b.job_id, count(*) AS topic_blocks, max(b.end_) - min(b.start_) AS source_span, coalesce(max(keep_segments), 0) AS keep_segments, coalesce(max(delete_segments), 0) AS delete_segments, coalesce(max(keep_duration), 0) AS keep_duration,
        coalesce(max(delete_duration), 0) AS delete_duration, coalesce(max(decisions), 0) AS decisions, coalesce(max(keep_duration + delete_duration), 0) AS decided_duration,
        floor(coalesce(max(keep_duration) / nullif(max(keep_duration + delete_duration), 0), 0) * 1e6 + 0.123)::BIGINT AS keep_ppm FROM blocks b LEFT JOIN t USING (job_id) GROUP BY b.job_id""")
def cut_report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = L.report_metrics(V.blocks(spark, sf_dir), V.decisions(spark, sf_dir), _timeline(spark, sf_dir))
    return m.withColumn("keep_ppm", F.floor(F.col("keep_ratio") * 1e6 + 0.123).cast("long")).drop("keep_ratio")


@query(V.with_views("blocks", "decisions", "timeline") + " SELECT job_id, pos, id, end_ - start_ AS duration_ms FROM timeline WHERE decision = 'keep' AND end_ - start_ > 90000")
def long_keep_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.long_keeps(_timeline(spark, sf_dir), 90_000)
    return rows.select("job_id", "pos", "id", (F.col("end") - F.col("start")).alias("duration_ms"))


_PREVIEW = """tl AS (SELECT job_id, pos, start_, end_ FROM segments WHERE pos % 3 <> 1),
    k AS (SELECT *, coalesce(sum(end_ - start_) OVER (PARTITION BY job_id ORDER BY start_, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, row_number() OVER (PARTITION BY job_id ORDER BY start_, pos) AS no FROM (SELECT job_id, pos, start_ - 300 AS start_, end_ - 100 AS end_ FROM tl)),
    j AS (SELECT s.job_id, s.pos, k.no, greatest(s.start_, k.start_) - k.start_ + k.base AS a, least(s.end_, k.end_) - k.start_ + k.base AS b, s.text, s.speaker, row_number() OVER (PARTITION BY s.job_id ORDER BY k.no, s.pos) AS n
        FROM segments s JOIN k ON k.job_id = s.job_id AND least(s.end_, k.end_) > greatest(s.start_, k.start_))"""


@query(V.with_views("segments") + "," + _PREVIEW + " SELECT job_id, n - 1 AS pos, printf('preview_%04d', n) AS id, a::BIGINT AS start_ms, b::BIGINT AS end_ms, text, speaker FROM j")
def preview_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.segments(spark, sf_dir)
    timeline = s.select("job_id", "pos", (F.col("start") - 300).alias("start"), (F.col("end") - 100).alias("end"), F.when(F.col("pos") % 3 == 1, "delete").otherwise("keep").alias("decision"))
    return L.preview(s, timeline, digits=None).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})


@query("""WITH p AS (SELECT c_custkey, c_name AS a, lead(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer)
    SELECT c_custkey, a, b, CASE WHEN length(a) = length(b) THEN hamming(a, b)::INT END AS distance, CASE WHEN a = b THEN a WHEN length(a) = length(b) AND hamming(a, b) <= 1 THEN a END AS stable,
    coalesce(length(a) = length(b) AND length(a) >= 8 AND hamming(a, b) > 1 AND hamming(a, b) <= greatest(2, length(a) // 8), false) AS jitter FROM p WHERE b IS NOT NULL""")
def hamming_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("a"), F.lead("c_name").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("b")).filter("b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    return c.select("c_custkey", "a", "b", T.hamming(a, b).alias("distance"), T.stable_text(a, b).alias("stable"), T.reading_jitter(a, b).alias("jitter"))


_OBJECT = """'{"edit_decisions": [{"block_id": "B' || doc_id || '", "decision": "' || CASE WHEN quality = 1 THEN 'keep' ELSE 'delete' END || '"}]}'"""
_REPLY = f"""CASE doc_id % 4 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || {_OBJECT} || chr(10) || '```' WHEN 1 THEN {_OBJECT} WHEN 2 THEN 'so ' || {_OBJECT} || ' it is' ELSE 'not json ' || doc_id END"""


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'B' || doc_id END AS block_id, CASE WHEN doc_id % 4 < 3 THEN CASE WHEN quality = 1 THEN 'keep' ELSE 'delete' END END AS decision FROM labels")
def json_extract_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "labels").select("doc_id", F.expr(_REPLY).alias("reply"))
    found = F.try_parse_json(T.json_object(F.col("reply")))
    get = lambda n: F.try_variant_get(found, f"$.edit_decisions[0].{n}", "string").alias(n)
    return rows.select("doc_id", get("block_id"), get("decision"))


@query("""SELECT event_id AS job_id, (event_id % 1000) * 1.5 AS duration, CASE WHEN event_id % 5 > 0 THEN (640 + event_id % 7)::INT END AS width, CASE WHEN event_id % 5 > 0 THEN (480 + event_id % 3)::INT END AS height,
    CASE WHEN event_id % 5 > 0 AND event_id % 4 > 0 THEN 30000 / (event_id % 4) END AS fps, CASE WHEN event_id % 5 > 0 THEN event_type END AS video_codec, 'aac' AS audio_codec FROM events""")
def media_first_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        '{"format": {"duration": "%s"}, "streams": [{"codec_type": "audio", "codec_name": "aac", "index": 0}%s, {"codec_type": "subtitle", "index": 9}]}', (F.col("event_id") % 1000 * 1.5).cast("string"),
        F.when(F.col("event_id") % 5 > 0, F.format_string(', {"codec_type": "video", "codec_name": "%s", "width": %d, "height": %d, "avg_frame_rate": "30000/%d"}, {"codec_type": "video", "codec_name": "second"}', "event_type", 640 + F.col("event_id") % 7, 480 + F.col("event_id") % 3, F.col("event_id") % 4)).otherwise(""),
    )
    return R.media_info(V.table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), text.alias("payload")))


@query("""SELECT conv_id AS job_id, turn AS pos, printf('seg_%04d', turn + 1) AS id, (turn * 1000 + 200) / 1000 AS start_s, (turn * 1000 + 900) / 1000 AS end_s, role AS speaker, length(text) AS chars_said FROM
    (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations)""")
def speech_to_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.table(spark, sf_dir, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    info = t.withColumn("n", n).select("conv_id", "n", F.struct("text", (F.col("n") * 1000 + 200).alias("start"), (F.col("n") * 1000 + 900).alias("end"), F.col("role").alias("spk")).alias("s"))
    said = info.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x.s).alias("sentence_info"))
    results = said.select(F.col("conv_id").alias("job_id"), F.to_json(F.array(F.struct("sentence_info"))).alias("payload"))
    out = R.speech_segments(results)
    return out.select("job_id", "pos", "id", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "speaker", F.length("text").cast("long").alias("chars_said"))


@query(r"""SELECT page_id, CASE WHEN t = '' THEN 'default' ELSE t END AS name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\s]+', '_', 'g'), '_+', '_', 'g'), '._- ') AS t FROM pages)""")
def safe_job_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", T.job_name(F.col("url")).alias("name"))


_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"


@query(V.with_views("segments") + f""" SELECT job_id, string_agg(n || chr(10) || {_SRT.format("start_")} || ' --> ' || {_SRT.format("end_")} || chr(10) || text, chr(10) || chr(10) ORDER BY pos) || chr(10) AS srt
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS n FROM segments) GROUP BY job_id""")
def srt_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.segments(spark, sf_dir)
    return K.srt(s.withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000}))


@query(V.with_views("segments", "sentences") + "," + _BLOCKS + f""", lines AS (SELECT job_id, block_no, '[' || printf('B%04d', block_no) || ' | ' || replace(left({_SRT.format("start_ms")}, 11), ',', '.') || '-' || replace(left({_SRT.format("end_ms")}, 11), ',', '.')
    || ' | ' || sentence_count || ' sentences' || CASE WHEN coalesce(speaker, '') <> '' THEN ' | spk=' || speaker ELSE '' END || ']' || chr(10) || text AS line FROM made)
    SELECT job_id, '{K.BLOCK_LIST_HEAD}' || chr(10) || rtrim(string_agg(line, chr(10) || chr(10) ORDER BY block_no), ' ' || chr(10)) || chr(10) AS markdown FROM lines GROUP BY job_id""")
def compact_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.block_list(_blocks(spark, sf_dir).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000}))


@query("SELECT conv_id AS job_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.job_text(V.segments(spark, sf_dir))


@query()
def cut_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = {"start": F.col("start") / 1000, "end": F.col("end") / 1000}
    blocks, decisions = V.blocks(spark, sf_dir).withColumns(seconds), V.decisions(spark, sf_dir)
    jobs = blocks.select("job_id", F.col("job_id").alias("source")).distinct()
    chapters = blocks.filter("pos % 40 = 0").select("job_id", "pos", F.col("id").alias("title"), F.col("id").alias("start_block_id"), F.col("id").alias("end_block_id"), F.lit("").alias("summary"))
    return L.cut_report(jobs, blocks, chapters, decisions, L.plan_to_timeline(decisions, blocks))
