"""Schemas of the tables, and rules that their rows must meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAR = "struct<text: string, start: double, end: double>"
FEATURES = "struct<audio: string, visual: string, speaker: string, scene: string>"
SEGMENT = f"id string, start double, end double, text string, chars array<{CHAR}>, speaker string"
SENTENCE = f"id string, source_segment_id string, start double, end double, text string, speaker string, pause_after double, features {FEATURES}"
BLOCK = f"id string, start_sentence_id string, end_sentence_id string, start double, end double, text string, sentence_count int, speaker string, features {FEATURES}"
CHAPTER = "title string, start_block_id string, end_block_id string, summary string"
DECISION = "block_id string, decision string, reason string, title string, confidence double"
TIMELINE = "id string, start double, end double, decision string, text string, reason string, confidence double"
SAMPLE = "timestamp double, text string, score double"
QUALITY = (
    "sentence_count int, duration double, max_sentence_duration double, long_sentence_count int, noise_token_ratio double,"
    " chinese_char_ratio double, repeated_char_run_count int, score double, recommendation string, reasons array<string>"
)

#: Envelope of a job's file: the name of its list, and the list's rows.
ENVELOPES = {
    "transcript": ("source string, language string", {"segments": SEGMENT}),
    "sentences": ("source string", {"sentences": SENTENCE}),
    "blocks": ("source string", {"blocks": BLOCK}),
    "plan": ("", {"chapters": CHAPTER, "edit_decisions": DECISION}),
    "timeline": ("source string", {"segments": TIMELINE}),
}


def rows_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class Rule:
    name: str
    holds: str  # SQL


def interval_rules(strict: bool = True) -> list[Rule]:
    rules = [Rule("start is 0 or more", "start >= 0"), Rule("end is above 0", "`end` > 0")]
    return [*rules, Rule("end is after start", "`end` > start")] if strict else rules


def share_rule(name: str) -> Rule:
    return Rule(f"{name} is between 0 and 1", f"{name} IS NULL OR {name} BETWEEN 0 AND 1")


def decision_rule() -> Rule:
    return Rule("decision is keep or delete", "decision IN ('keep', 'delete')")


RULES = {
    "segments": interval_rules(),
    "sentences": [*interval_rules(), Rule("pause_after is 0 or more", "coalesce(pause_after, 0) >= 0")],
    "blocks": [*interval_rules(), Rule("sentence_count is above 0", "sentence_count > 0")],
    "timeline": [*interval_rules(), decision_rule(), share_rule("confidence")],
    "edit_decisions": [decision_rule(), share_rule("confidence")],
    "samples": [Rule("timestamp is 0 or more", "timestamp >= 0"), share_rule("score")],
    "ranges": interval_rules(strict=False),
}


def broken(rules: list[Rule]) -> Column:
    """Names of the rules that a row breaks; a null outcome breaks a rule."""
    return F.filter(F.array(*[F.when(F.coalesce(F.expr(r.holds), F.lit(False)), None).otherwise(F.lit(r.name)) for r in rules]), lambda n: n.isNotNull())


def validated(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows; the query stops at a row that breaks a rule."""
    names = broken(rules)
    return df.filter(F.when(F.size(names) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid row: "), F.array_join(names, "; "))).cast("boolean")))


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the names of the broken rules)."""
    marked = df.withColumn("broken", broken(rules))
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)
