"""Edit plans from a decider: a language model behind a URL, or a rule that needs none."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.functions import text as T
from cueline.schema import CHAPTER, DECISION, rows_of

# The instructions that a model gets.
SYSTEM_PROMPT = "你是一个视频剪辑决策助手。你的任务是根据分块后的字幕内容，输出严格 JSON，用于自动粗剪。不要输出解释，不要输出 Markdown。"
USER_PROMPT = """请根据下面的 transcript blocks 生成自动剪辑决策。

要求：
1. 只能使用输入里出现过的 block_id，不要编造时间戳。
2. edit_decisions 中每个对象必须包含 block_id、decision、reason、title、confidence。
3. decision 只能是 keep 或 delete。
4. title 用中文短标题，适合视频章节或片段标题。
5. confidence 是 0 到 1 的数字。
6. 输出必须是 JSON 对象，不要输出 Markdown 或解释文字。

JSON 格式：
{ "chapters": [{ "title": "", "start_block_id": "B0001", "end_block_id": "B0001", "summary": "" }], "edit_decisions": [{ "block_id": "B0001", "decision": "keep", "reason": "", "title": "", "confidence": 0.9 }] }

"""


class DeciderError(RuntimeError):
    """A decider is not configured, or its reply is of no use."""


@dataclass(frozen=True)
class Config:
    model: str
    base_url: str
    api_key: str | None = None
    wire_api: str = "chat_completions"
    reasoning_effort: str | None = None
    store: bool = False
    temperature: float = 0.2
    timeout: float = 120
    json_mode: bool = True


def load_env(path: str) -> None:
    """Set the variables of a .env file that are not set yet; blank lines, comments and lines without = are skipped."""
    if not os.path.exists(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, eq, value = line.strip().partition("=")
            if eq and name and not name.startswith("#"):
                os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def flag(name: str, default: bool) -> bool:
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def wire_api(value: str) -> str:
    v = value.strip().lower().replace("-", "_")
    if v in ("chat", "chat_completions", "chat_completion"):
        return "chat_completions"
    if v in ("response", "responses"):
        return "responses"
    raise DeciderError(f"unknown wire API {value!r}")


def config_from_env(prefix: str = "CUELINE_LLM_", **given: object) -> Config:
    """Arguments first, then the environment, then defaults. No endpoint is built in: one must be named."""
    load_env(".env")
    env = lambda n: given.get(n) if given.get(n) is not None else os.environ.get(prefix + n.upper())
    if not env("model"):
        raise DeciderError(f"no model: set {prefix}MODEL")
    if not env("base_url"):
        raise DeciderError(f"no endpoint: set {prefix}BASE_URL")
    more = {k: v for k, v in given.items() if k in ("temperature", "timeout", "json_mode") and v is not None}
    return Config(str(env("model")), str(env("base_url")), env("api_key"), wire_api(str(env("wire_api") or "chat_completions")), env("reasoning_effort"), flag(prefix + "STORE", False), **more)


def endpoint(config: Config) -> str:
    tail = "/responses" if config.wire_api == "responses" else "/chat/completions"
    base = config.base_url.rstrip("/")
    return base if base.endswith(tail) else base + tail


def request_body(config: Config, system: str, user: str) -> dict:
    turns = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    if config.wire_api == "responses":
        body: dict = {"model": config.model, "input": turns, "store": config.store}
        return body | ({"reasoning": {"effort": config.reasoning_effort}} if config.reasoning_effort else {})
    body = {"model": config.model, "messages": turns, "temperature": config.temperature}
    return body | ({"response_format": {"type": "json_object"}} if config.json_mode else {})


def reply_text(data: dict) -> str:
    """The text of a reply in either shape."""
    if isinstance(data.get("output_text"), str):
        return data["output_text"]
    if data.get("choices"):
        return data["choices"][0]["message"]["content"] or ""
    parts = [c for item in data.get("output", []) if isinstance(item, dict) for c in item.get("content", []) if isinstance(c, dict)]
    return "".join(next((c[k] for k in ("text", "content") if isinstance(c.get(k), str)), "") for c in parts)


def ask(config: Config, system: str, user: str) -> str:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {config.api_key}"} if config.api_key else {})
    request = urllib.request.Request(endpoint(config), json.dumps(request_body(config, system, user)).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=config.timeout) as r:
            return reply_text(json.loads(r.read()))
    except urllib.error.HTTPError as e:
        raise DeciderError(f"the endpoint answered {e.code}: {e.read().decode(errors='replace')[:500]}") from e
    except (urllib.error.URLError, KeyError, IndexError, ValueError) as e:
        raise DeciderError(f"no usable reply: {e}") from e


def decide(lists: DataFrame, reply: Callable[[str, str], str]) -> DataFrame:
    """(job_id, content): the decider's reply to each job's block list (job_id, markdown). One call a job, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"job_id": b["job_id"], "content": [reply(SYSTEM_PROMPT, USER_PROMPT + m) for m in b["markdown"]]})

    kind = lists.schema["job_id"].dataType.simpleString()
    return lists.select("job_id", "markdown").mapInPandas(run, f"job_id {kind}, content string")


def plan_rows(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, decisions) of replies (job_id, content); a reply without a plan stops the query."""

    def fields(ddl: str) -> str:
        return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows_of(ddl))

    shape = f"chapters array<struct<{fields(CHAPTER)}>>, edit_decisions array<struct<{fields(DECISION)}>>"
    found = T.json_object(F.col("content"))
    bad = F.raise_error(F.concat(F.lit("no JSON object in the reply of job "), F.col("job_id").cast("string"))).cast("string")
    plans = replies.select("job_id", F.from_json(F.when(found.isNull(), bad).otherwise(found), shape).alias("plan"))
    listed = lambda name: plans.select("job_id", F.posexplode(f"plan.{name}").alias("pos", "row")).select("job_id", F.col("pos").cast("long").alias("pos"), "row.*")
    none = plans.filter(F.coalesce(F.size("plan.edit_decisions"), F.lit(0)) == 0)
    decisions = listed("edit_decisions").fillna({"reason": "", "title": ""})
    failed = none.select(F.raise_error(F.concat(F.lit("no decisions in the reply of job "), F.col("job_id").cast("string"))).cast("long").alias("pos"))
    decisions = decisions.unionByName(failed.select(*[F.col("pos").cast("string").cast(decisions.schema[c].dataType).alias(c) for c in decisions.columns]))
    return listed("chapters"), decisions


def keep_by_rule(blocks: DataFrame, *, min_chars: int = 2, max_noise: float = 0.3) -> DataFrame:
    """Decisions without a model: blocks of hardly any text, or mostly hesitation, go."""
    bad = (F.length(T.squeeze(F.col("text"))) < min_chars) | (T.noise_share(F.col("text")) > max_noise)
    return blocks.select(
        "job_id", "pos", F.col("id").alias("block_id"), F.when(bad, "delete").otherwise("keep").alias("decision"), F.when(bad, "little content").otherwise("").alias("reason"), F.lit("").alias("title"), F.lit(0.5).alias("confidence")
    )
