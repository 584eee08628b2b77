import json

import __spark_entry__ as entry_points
import duckdb
import pytest
from cueline import cli, queries
from cueline.plans import decider
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows
    if name in queries.ORACLE:
        want = db.sql(queries.ORACLE[name])
        assert sorted(want.columns) == columns
        place = [want.columns.index(c) for c in columns]
        assert sorted([tuple(plain(r[c]) for c in columns) for r in rows], key=repr) == sorted([tuple(plain(r[i]) for i in place) for r in want.fetchall()], key=repr)


def test_quality_report_compares_and_rounds_like_its_sql(spark, tmp_path):
    """Turns of exactly 30, 60 and 90 seconds at many starts, and ratios that four digits don't hold."""
    texts = ["x" * 1500, "x" * 1501, "今" * 3000, "嗯" + "今" * 31, "嗯a今" * 7 + "b"]
    rows = [(n * 5 + k, t, "user", text) for n in range(40) for k, last in enumerate(texts) for t, text in enumerate(["y" * (n * 7), last, "今" * 4500])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want, got = con.sql(queries.ORACLE["quality_report"]), queries.quality_report(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())


def test_entry_points(spark):
    assert set(queries.QUERIES) <= set(entry_points.queries()) and set(queries.ORACLE) <= set(entry_points.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


def write(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_job_files_end_to_end(spark, tmp_path, capsys):
    chars: list = []
    transcript = write(tmp_path / "t.json", {"source": "v.mp4", "language": "zh", "segments": [
        {"id": "seg_001", "start": 0, "end": 10, "text": "核心内容。", "chars": chars, "speaker": None}, {"id": "seg_002", "start": 12, "end": 40, "text": "重复内容。", "chars": chars, "speaker": None}]})
    index, blocks, out = str(tmp_path / "i.json"), str(tmp_path / "b.json"), tmp_path
    assert cli.main(["build-index", transcript, index]) == 0
    assert cli.main(["build-blocks", index, blocks, "--min-duration", "5", "--split-pause", "1"]) == 0
    assert [b["id"] for b in json.loads((tmp_path / "b.json").read_text())["blocks"]] == ["B0001", "B0002"]
    assert cli.main(["compact", blocks, str(out / "b.md")]) == 0 and "[B0001 | 00:00:00.00-00:00:10.00 | 1 sentences]" in (out / "b.md").read_text()
    assert cli.main(["assess-transcript", index, str(out / "q.json")]) == 0 and json.loads((out / "q.json").read_text())["recommendation"] == "asr_usable"
    plan = write(tmp_path / "p.json", {"chapters": [], "edit_decisions": [{"block_id": "B0001", "decision": "keep", "reason": "", "title": "", "confidence": 0.9}, {"block_id": "B0002", "decision": "delete", "reason": "", "title": "", "confidence": 0.5}]})
    assert cli.main(["apply-plan", plan, blocks, "--job", "demo", "--transcript", transcript, "--runs", str(out / "r"), "--outputs", str(out / "o")]) == 0
    assert "- Keep ratio: 26.3%" in (out / "o/demo.report.md").read_text()
    assert (out / "o/demo.srt").read_text() == "1\n00:00:00,000 --> 00:00:10,000\n核心内容。\n"
    assert [s["decision"] for s in json.loads((out / "r/demo/timeline.json").read_text())["segments"]] == ["keep", "delete"]
    timeline = str(out / "r/demo/timeline.json")
    assert cli.main(["preview-srt", transcript, timeline, str(out / "p.srt")]) == 0
    assert cli.main(["export-srt", transcript, str(out / "t.srt")]) == 0 and (out / "t.srt").read_text().startswith("1\n")
    bad = write(tmp_path / "bad.json", {"edit_decisions": [{"block_id": "B9", "decision": "keep", "reason": "", "title": "", "confidence": 0.9}]})
    assert cli.main(["plan-to-timeline", bad, blocks, str(out / "x.json")]) == 1
    assert cli.main(["compact", "nowhere.json", "x"]) == 1 and "nowhere.json" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["build-blocks", index, blocks, "--min-duration", "0"])
    assert cli.main(["doctor"]) == 0


def test_decider(spark, monkeypatch, tmp_path):
    lists = spark.createDataFrame([("a", "[B0001]"), ("b", "[B0002]")], "job_id string, markdown string")

    def reply(system, user):
        block = user.rsplit("[", 1)[1].rstrip("]")
        return '```json\n{"chapters": [], "edit_decisions": [{"block_id": "%s", "decision": "keep"}]}\n```' % block

    _, decisions = decider.plan_rows(decider.decide(lists, reply))
    assert sorted((r.job_id, r.block_id, r.decision, r.reason) for r in decisions.collect()) == [("a", "B0001", "keep", ""), ("b", "B0002", "keep", "")]
    for text in ("not json", '{"edit_decisions": []}'):
        with pytest.raises(Exception, match="of job"):
            decider.plan_rows(lists.select("job_id", F.lit(text).alias("content")))[1].collect()
    assert decider.reply_text({"output": [{"content": [{"type": "output_text", "text": '{"a": 1}'}]}]}) == '{"a": 1}'
    assert decider.reply_text({"choices": [{"message": {"content": "x"}}]}) == "x"
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("# note\nCUELINE_LLM_MODEL='m'\nnothing\nCUELINE_LLM_BASE_URL=http://h/v1/\n")
    for n in ("MODEL", "BASE_URL"):
        monkeypatch.setenv(f"CUELINE_LLM_{n}", "")
        monkeypatch.delenv(f"CUELINE_LLM_{n}")
    config = decider.config_from_env()
    assert config.model == "m" and decider.endpoint(config) == "http://h/v1/chat/completions"
    assert decider.endpoint(decider.config_from_env(wire_api="Responses")) == "http://h/v1/responses"
    assert decider.request_body(config, "s", "u")["response_format"] == {"type": "json_object"}
    with pytest.raises(decider.DeciderError):
        decider.config_from_env(wire_api="fax")


def test_rule_decider(spark):
    b = spark.createDataFrame([("j", 0, "B1", "嗯嗯嗯好"), ("j", 1, "B2", "今天介绍流程")], "job_id string, pos long, id string, text string")
    assert [r.decision for r in decider.keep_by_rule(b).orderBy("pos").collect()] == ["delete", "keep"]
