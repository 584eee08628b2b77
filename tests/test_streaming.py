import datetime as dt

from cueline.operators import samples as S
from cueline.operators import windows as W
from cueline.streaming import sessions
from pyspark.sql import functions as F


def run(spark, df, folder, make, name, parts=3):
    """Feed rows in time order as files, one a micro-batch, and collect what the query emits."""
    rows = sorted(df.collect(), key=lambda r: r["at"])
    schema, size = df.schema, -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/part{i}")
        for f in (folder / f"part{i}").glob("*.parquet"):
            f.rename(folder / f"{i}.parquet")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_presence_sessions_equal_batch(spark, tmp_path):
    hits = [(j, float(t), at(t), True) for j in ("a", "b") for t in (1, 2, 6, 7, 9, 20, 21)] + [("z", 500.0, at(500), True)]
    df = spark.createDataFrame(hits, "job_id string, ts double, at timestamp, has_subtitle boolean")
    got = run(spark, df, tmp_path, lambda s: sessions.presence_sessions(s, interval=1.0, max_gap=1.5, delay="1 second"), "presence")
    batch = W.presence_ranges(df.filter("job_id <> 'z'"), interval=1.0, max_gap=1.5, expand=0.0).collect()
    second = lambda t: (t - at(0)).total_seconds()
    assert sorted((r.job_id, second(r.first_at), second(r.last_at) + 1) for r in got) == sorted(map(tuple, batch))


def test_merge_samples_equal_batch(spark, tmp_path):
    rows = []
    for j in ("a", "b"):
        for t, text in enumerate(["第一句", "第一句", "", "下界是何声响", "C下界是何声响", "去吧", "去吧", "来吧", "来吧"]):
            rows.append((j, t, float(t), at(t), text, 0.9))
    rows.append(("z", 0, 900.0, at(900), "x", 0.9))
    df = spark.createDataFrame(rows, "job_id string, pos long, ts double, at timestamp, text string, score double")
    got = run(spark, df, tmp_path, lambda s: sessions.merge_samples_stream(s, interval=1.0, delay="1 second"), "merged")
    batch = S.merge_samples(df.filter("job_id <> 'z'"), interval=1.0).select("job_id", "start", "end", "text", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(got) == 8


def test_dedupe_equal_batch(spark, tmp_path):
    rows = [("j", i, float(i), at(i), s) for i, s in enumerate([[0], [1], [3], [255], None, [255], [254], [254]])]
    df = spark.createDataFrame(rows, "job_id string, pos long, ts double, at timestamp, signature array<bigint>")
    got = run(spark, df, tmp_path, lambda s: sessions.dedupe_stream(s, threshold=1), "dedupe")
    batch = W.dedupe_frames(df.drop("at"), threshold=1).select("job_id", "pos", "action", F.col("source_pos")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, batch), key=str)
