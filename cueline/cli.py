"""Command line: jobs' files in, jobs' files out."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from cueline.plans import decider
from cueline.sources import media


@dataclass(frozen=True)
class JobPaths:
    """Where a job's files lie."""

    job: str
    runs: str = "runs"
    outputs: str = "outputs"

    def run(self, name: str) -> str:
        return os.path.join(self.runs, self.job, name)

    def output(self, ending: str) -> str:
        return os.path.join(self.outputs, f"{self.job}{ending}")


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("cueline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _write(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _read(kind: str, path: str, part: str | None = None):
    from cueline.schema import RULES, validated
    from cueline.sources import tables

    if not os.path.exists(path):
        raise ValueError(f"no such file: {path}")
    rows = tables.read_table(_spark(), path, kind, part)
    rules = RULES.get(part or {"transcript": "segments", "sentences": "sentences", "blocks": "blocks", "plan": "chapters", "timeline": "timeline"}[kind])
    # a command works on one job's files, whose names differ
    from pyspark.sql import functions as F

    return (validated(rows, rules) if rules else rows).withColumn("job_id", F.lit("job"))


def _one(rows, column: str, what: str) -> str:
    found = rows.select(column).first()
    if found is None:
        raise ValueError(f"{what} would be empty")
    return found[0]


def _segments_without_envelope(rows):
    return rows.drop("source", "language")


def _source(rows) -> dict:
    """The envelope of a job's next file: the source that its rows name."""
    from pyspark.sql import functions as F

    row = rows.select("source").first()
    return {"source": F.lit(row[0] if row else None).cast("string")}


def _export_srt(a: argparse.Namespace) -> None:
    from cueline.sources import tables

    kind = "sentences" if a.command == "export-index-srt" else "transcript"
    _write(a.output, _one(tables.srt(_read(kind, a.input)), "srt", "the subtitles"))


def _build_index(a: argparse.Namespace) -> None:
    from cueline.operators import sentences
    from cueline.sources import tables

    rows = _read("transcript", a.input)
    _write(a.output, _one(tables.to_json(sentences.sentence_index(_segments_without_envelope(rows)), "sentences", _source(rows)), "json", "the index"))


def _build_blocks(a: argparse.Namespace) -> None:
    from cueline.operators import sentences
    from cueline.sources import tables

    rows = _read("sentences", a.input)
    blocks = sentences.topic_blocks(_segments_without_envelope(rows), min_duration=a.min_duration, max_duration=a.max_duration, split_pause=a.split_pause)
    _write(a.output, _one(tables.to_json(blocks, "blocks", _source(rows)), "json", "the blocks"))


def _compact(a: argparse.Namespace) -> None:
    from cueline.sources import tables

    _write(a.output, _one(tables.block_list(_read("blocks", a.input)), "markdown", "the list"))


def _assess(a: argparse.Namespace) -> None:
    from cueline.operators import sentences

    row = sentences.quality(_read("sentences", a.input)).first()
    if row is None:
        raise ValueError("the index has no sentences")
    _write(a.output, json.dumps({k: v for k, v in row.asDict().items() if k != "job_id"}, ensure_ascii=False, indent=2))


def _timeline(a: argparse.Namespace):
    from cueline.operators import timeline

    return timeline.plan_to_timeline(_read("plan", a.plan, "edit_decisions"), _read("blocks", a.blocks))


def _plan_to_timeline(a: argparse.Namespace) -> None:
    from cueline.sources import tables

    _write(a.output, _one(tables.to_json(_timeline(a), "segments", _source(_read("blocks", a.blocks))), "json", "the timeline"))


def _report_text(a: argparse.Namespace, rows) -> str:
    from cueline.operators import timeline
    from pyspark.sql import functions as F

    blocks = _read("blocks", a.blocks)
    jobs = blocks.select("job_id", "source").distinct().withColumn("render_output", F.lit(getattr(a, "render", None)).cast("string"))
    found = timeline.cut_report(jobs, blocks, _read("plan", a.plan, "chapters"), _read("plan", a.plan, "edit_decisions"), rows)
    return _one(found, "report", "the report").replace("# Cut Report: job\n", f"# Cut Report: {a.job}\n", 1)


def _report(a: argparse.Namespace) -> None:
    _write(a.output, _report_text(a, _read("timeline", a.timeline)))


def _preview_rows(transcript: str, rows):
    from cueline.operators import timeline

    return timeline.preview(_segments_without_envelope(_read("transcript", transcript)), rows)


def _preview(a: argparse.Namespace) -> None:
    from cueline.sources import tables

    _write(a.output, _one(tables.srt(_preview_rows(a.transcript, _read("timeline", a.timeline))), "srt", "the preview"))


def _apply_plan(a: argparse.Namespace) -> None:
    from cueline.sources import tables

    paths, rows = JobPaths(a.job, a.runs, a.outputs), _timeline(a)
    _write(paths.run("timeline.json"), _one(tables.to_json(rows, "segments"), "json", "the timeline"))
    _write(paths.output(".report.md"), _report_text(a, rows))
    if a.transcript:
        _write(paths.output(".srt"), _one(tables.srt(_preview_rows(a.transcript, rows)), "srt", "the preview"))
    if a.video:
        _render_rows(a.video, rows, paths.output(".mp4"), paths.run("parts"))


def _render_rows(video: str, rows, output: str, work: str) -> None:
    os.makedirs(work, exist_ok=True)
    kept = rows.filter("decision = 'keep'").orderBy("start", "pos").select("start", "end").collect()
    media.render(video, [(r["start"], r["end"]) for r in kept], output, work=work)


def _render(a: argparse.Namespace) -> None:
    _render_rows(a.video, _read("timeline", a.timeline), a.output, a.work)


def _plan(a: argparse.Namespace) -> None:
    with open(a.input, encoding="utf-8") as f:
        text = f.read()
    config = decider.config_from_env(model=a.model, base_url=a.base_url)
    reply = decider.ask(config, decider.SYSTEM_PROMPT, decider.USER_PROMPT + text)
    from cueline.functions import text as T
    from pyspark.sql import functions as F

    found = _spark().createDataFrame([(reply,)], "reply string").select(T.json_object(F.col("reply"))).first()[0]
    if found is None or not json.loads(found).get("edit_decisions"):
        raise decider.DeciderError("the reply holds no plan")
    _write(a.output, json.dumps(json.loads(found), ensure_ascii=False, indent=2))


def _doctor(a: argparse.Namespace) -> None:
    for name, path in media.tools().items():
        print(f"{name}: {path or 'missing'}")


def _probe(a: argparse.Namespace) -> None:
    from cueline.operators import recognition

    rows = _spark().createDataFrame([("job", json.dumps(media.probe(a.video)))], "job_id string, payload string")
    found = recognition.subtitle_streams(rows) if a.command == "probe-subtitles" else recognition.media_info(rows)
    for r in found.collect():
        print(json.dumps({k: v for k, v in r.asDict().items() if k != "job_id"}, ensure_ascii=False))


def _audio(a: argparse.Namespace) -> None:
    media.extract_audio(a.video, a.output, a.sample_rate)


def _positive(text: str) -> float:
    value = float(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("must be above 0")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cueline", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *args: str, **options) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for x in args:
            c.add_argument(x)
        for x, default in options.items():
            kind = _positive if isinstance(default, float) else int if isinstance(default, int) else str
            c.add_argument(f"--{x.replace('_', '-')}", default=default, type=kind)
        return c

    command("doctor", _doctor)
    command("probe", _probe, "video")
    command("probe-subtitles", _probe, "video")
    command("extract-audio", _audio, "video", "output", sample_rate=16_000)
    command("export-srt", _export_srt, "input", "output")
    command("export-index-srt", _export_srt, "input", "output")
    command("build-index", _build_index, "input", "output")
    command("build-blocks", _build_blocks, "input", "output", min_duration=20.0, max_duration=60.0, split_pause=1.2)
    command("compact", _compact, "input", "output")
    command("assess-transcript", _assess, "input", "output")
    command("plan-to-timeline", _plan_to_timeline, "plan", "blocks", "output")
    command("report", _report, "plan", "blocks", "timeline", "output", job="default", render=None)
    command("preview-srt", _preview, "transcript", "timeline", "output")
    command("apply-plan", _apply_plan, "plan", "blocks", job="default", transcript=None, video=None, runs="runs", outputs="outputs")
    command("render", _render, "video", "timeline", "output", work="parts")
    for name in ("llm-plan", "decide-edits"):
        command(name, _plan, "input", "output", model=None, base_url=None)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(a)
    except (ValueError, OSError, media.MediaError, decider.DeciderError) as e:
        print(f"cueline: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # what a query raises on bad rows
        from pyspark.errors import PySparkException

        if not isinstance(e, PySparkException) and "Py4J" not in type(e).__name__:
            raise
        print(f"cueline: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0
