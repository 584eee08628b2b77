"""Edit plans: decisions joined to blocks, the kept timeline, its preview and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions import text as T
from cueline.functions import time as M

from .windows import ordered


def joined_lines(order: Column, line: Column, sep: str) -> Column:
    """An aggregate: lines joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x.l), sep)


def last_blocks(blocks: DataFrame) -> DataFrame:
    """Of blocks that share an id the last counts."""
    return blocks.groupBy("job_id", "id").agg(F.max_by(F.struct("start", "end", "text"), "pos").alias("block"))


def plan_to_timeline(decisions: DataFrame, blocks: DataFrame, *, strict: bool = True) -> DataFrame:
    """Timeline segments (job_id, pos, id, start, end, decision, text, reason, confidence) in the order of the decisions.

    A decision on an unknown block stops the query (``strict``) or is left out. A segment's text is the decision's title, else the block's text.
    """
    known = last_blocks(blocks).select("job_id", F.col("id").alias("block_id"), "block")
    rows = decisions.join(known, ["job_id", "block_id"], "left")
    if strict:
        wrong = F.raise_error(F.concat(F.lit("unknown block: "), F.col("block_id")))
        rows = rows.withColumn("block", F.when(F.col("block").isNull(), wrong.cast(rows.schema["block"].dataType)).otherwise(F.col("block")))
    else:
        rows = rows.filter("block IS NOT NULL")
    title = F.coalesce(F.nullif("title", F.lit("")), "block.text")
    return rows.select("job_id", "pos", F.col("block_id").alias("id"), "block.start", "block.end", "decision", title.alias("text"), "reason", "confidence")


def missing_decisions(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    return blocks.join(decisions.select("job_id", F.col("block_id").alias("id")).distinct(), ["job_id", "id"], "left_anti")


def kept(timeline: DataFrame) -> DataFrame:
    """Kept segments by start, with the time at which each begins in the cut."""
    w = ordered("start", "pos")
    before = F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return timeline.filter("decision = 'keep'").withColumns({"offset": F.coalesce(before, F.col("start") * 0), "keep_no": F.row_number().over(w)})


def preview(segments: DataFrame, timeline: DataFrame, digits: int | None = 3) -> DataFrame:
    """Transcript segments as they fall in the cut (job_id, pos, id, start, end, text, speaker): clipped to the kept segments and shifted."""
    k = kept(timeline).select(F.col("job_id").alias("k_job"), F.col("start").alias("k_start"), F.col("end").alias("k_end"), "offset", "keep_no")
    start, end = F.greatest("start", "k_start"), F.least("end", "k_end")
    rows = segments.join(k, (F.col("job_id") == F.col("k_job")) & (end > start))
    w = Window.partitionBy("job_id").orderBy("keep_no", "pos")
    n = F.row_number().over(w)
    shift = lambda c: c - F.col("k_start") + F.col("offset")
    rnd = lambda c: c if digits is None else F.bround(c, digits)
    return rows.select("job_id", (n - 1).cast("long").alias("pos"), F.format_string("preview_%04d", n).alias("id"), rnd(shift(start)).alias("start"), rnd(shift(end)).alias("end"), "text", "speaker")


def report_metrics(blocks: DataFrame, decisions: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row a job: counts, durations and shares of a cut."""
    span, of = F.col("end") - F.col("start"), lambda d: F.col("decision") == d
    t = timeline.groupBy("job_id").agg(
        F.count_if(of("keep")).alias("keep_segments"), F.count_if(of("delete")).alias("delete_segments"),
        F.coalesce(F.sum(F.when(of("keep"), span)), F.sum(span) * 0).alias("keep_duration"), F.coalesce(F.sum(F.when(of("delete"), span)), F.sum(span) * 0).alias("delete_duration"),
    )
    b = blocks.groupBy("job_id").agg(F.count("*").alias("topic_blocks"), (F.max("end") - F.min("start")).alias("source_span"))
    d = decisions.groupBy("job_id").agg(F.count("*").alias("decisions"))
    zero = {c: 0 for c in ("keep_segments", "delete_segments", "keep_duration", "delete_duration", "decisions")}
    m = b.join(t, "job_id", "left").join(d, "job_id", "left").fillna(zero)
    decided = F.col("keep_duration") + F.col("delete_duration")
    return m.withColumns({"decided_duration": decided, "keep_ratio": F.coalesce(F.try_divide(F.col("keep_duration"), decided), F.lit(0.0))})


def long_keeps(timeline: DataFrame, limit: float = 90) -> DataFrame:
    return timeline.filter((F.col("decision") == "keep") & (F.col("end") - F.col("start") > limit))


def cut_report(jobs: DataFrame, blocks: DataFrame, chapters: DataFrame, decisions: DataFrame, timeline: DataFrame) -> DataFrame:
    """(job_id, report): a Markdown report for each job of ``jobs`` (job_id, source[, render_output]); sections without lines are left out."""
    m = report_metrics(blocks, decisions, timeline).join(jobs, "job_id")
    fact = lambda name, value: F.concat(F.lit(f"- {name}: "), value.cast("string"))
    render = F.col("render_output").cast("string") if "render_output" in jobs.columns else F.lit(None).cast("string")
    head = F.array(
        F.concat(F.lit("# Cut Report: "), F.col("job_id").cast("string")), F.lit(""), F.lit("## Summary"), F.lit(""),
        fact("Source", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))), fact("Topic blocks", F.col("topic_blocks")), fact("Decisions", F.col("decisions")),
        fact("Keep segments", F.col("keep_segments")), fact("Delete segments", F.col("delete_segments")), fact("Source subtitle span", M.duration_text(F.col("source_span"))),
        fact("Decided duration", M.duration_text(F.col("decided_duration"))), fact("Estimated rough-cut duration", M.duration_text(F.col("keep_duration"))),
        fact("Removed duration", M.duration_text(F.col("delete_duration"))), fact("Keep ratio", M.percent_text(F.col("keep_ratio"))),
    )
    summary = m.select("job_id", F.concat_ws("\n", head, F.when(render.isNotNull(), fact("Render output", render))).alias("summary"), (F.col("keep_segments") == 0).alias("none_kept"))

    seen = timeline.join(last_blocks(blocks).select("job_id", "id", F.col("block.text").alias("block_text")), ["job_id", "id"], "left")
    shown = T.preview(F.coalesce("block_text", "text"))
    line = F.concat(
        F.lit("- "), F.col("id"), F.lit(" | "), M.clock_time(F.col("start")), F.lit("-"), M.clock_time(F.col("end")), F.lit(" | "), M.duration_text(F.col("end") - F.col("start")), F.lit(" | "), F.col("text"),
        F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit("\n  Reason: "), F.col("reason"))).otherwise(""), F.when(shown != "", F.concat(F.lit("\n  Text: "), shown)).otherwise(""),
    )
    seen = seen.withColumn("line", line)
    of = lambda d, name: seen.filter(F.col("decision") == d).groupBy("job_id").agg(joined_lines(F.col("pos"), F.col("line"), "\n").alias(name))
    long = long_keeps(timeline).groupBy("job_id").agg(joined_lines(F.col("pos"), F.col("id"), ", ").alias("long"))
    lost = missing_decisions(blocks, decisions).groupBy("job_id").agg(joined_lines(F.col("pos"), F.concat(F.lit("- "), F.col("id")), "\n").alias("lost"), F.count("*").alias("n_lost"))
    chapter = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.col("start_block_id"), F.lit(" -> "), F.col("end_block_id"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" | "), F.col("summary"))).otherwise(""))
    titles = chapters.groupBy("job_id").agg(joined_lines(F.col("pos"), chapter, "\n").alias("chapters"))
    rows = summary
    for part in (of("keep", "keep"), of("delete", "delete"), long, lost, titles):
        rows = rows.join(part, "job_id", "left")
    warn = F.concat_ws(
        "\n", F.when(F.col("none_kept"), F.lit("- No keep segments; render output would be empty.")), F.when(F.col("n_lost") > 0, F.concat(F.lit("- "), F.col("n_lost").cast("string"), F.lit(" blocks have no keep/delete decision."))),
        F.when(F.col("long").isNotNull(), F.concat(F.lit("- Long keep segments over 90s: "), F.col("long"), F.lit("."))),
    )
    section = lambda name, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"\n## {name}\n\n"), text))
    keep = F.concat(F.lit("\n## Keep Segments\n\n"), F.coalesce("keep", F.lit("")))
    text = F.concat_ws("\n", F.col("summary"), section("Warnings", warn), section("Chapters", F.col("chapters")), keep, section("Delete Segments", F.col("delete")), section("Missing Decisions", F.col("lost")))
    return rows.select("job_id", F.concat(F.rtrim(text, F.lit(" \n")), F.lit("\n")).alias("report"))
