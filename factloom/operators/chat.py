"""Text models behind an endpoint: one call, how it is repeated, and how a task asks for many replies.

A model is two functions, so that tests and other endpoints can stand in: a call that gives the text of a reply, and a call that gives the
arguments of a forced tool. Refused calls are never repeated, others are, after growing waits.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip, without_thinking
from factloom.operators.extraction import TextModel, asked
from factloom.sources.readers import replies_todo
from factloom.sources.stored import stored


class Refused(Exception):
    """The endpoint won't answer this request, however often it is made."""


class GaveUp(Exception):
    """All tries failed."""


class Busy(Exception):
    """A failure after which the endpoint named a time to wait, if it did."""

    def __init__(self, message: str, wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


@dataclass(frozen=True)
class Retries:
    """Waits in seconds: first doubles with each try up to most, and varies by a share of itself; an answer without content waits `empty`."""

    tries: int = 8
    first: float = 2.0
    most: float = 120.0
    share: float = 0.5
    least: float = 1.0
    empty: float = 3.0

    def wait(self, failed: int, named: float | None, draw: float) -> float:
        """After so many failures before this one; draw: from 0 to 1."""
        middle = min(self.most, self.first * 2**failed if named is None else named)
        return max(self.least, middle * (1 + self.share * (2 * draw - 1)))


def wait_seconds(failed: Column, named: Column, draw: Column, rule: Retries | None = None) -> Column:
    """Retries.wait of columns."""
    rule = rule or Retries()
    middle = F.least(F.lit(rule.most), F.coalesce(named.cast("double"), rule.first * F.pow(F.lit(2.0), failed)))
    return F.greatest(F.lit(rule.least), middle * (1 + rule.share * (2 * draw - 1)))


def persistent(call: Callable[[], str | dict], rule: Retries, *, keep_empty: bool = True, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> str | dict:
    """call()'s result. An empty one counts as a failure unless keep_empty; Refused passes through; GaveUp after the last try."""
    why: Exception | None = None
    for failed in range(rule.tries):
        try:
            if (found := call()) or keep_empty:
                return found
            wait = rule.empty
        except Refused:
            raise
        except Exception as e:  # noqa: BLE001  whatever a network brings
            why, wait = e, rule.wait(failed, getattr(e, "wait", None), draw())
        if failed < rule.tries - 1:
            sleep(wait)
    raise GaveUp(f"no answer after {rule.tries} tries") from why


@dataclass(frozen=True)
class Endpoint:
    """A service with the usual chat-completions interface over HTTP."""

    url: str
    model: str
    key: str = ""
    timeout: float = 120.0

    def post(self, body: dict) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}", "api-key": self.key} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, **body}).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]
        except urllib.error.HTTPError as e:
            if e.code in (400, 422):
                raise Refused(f"{e.code}: {e.reason}") from e
            named = e.headers.get("Retry-After", "")
            raise Busy(f"{e.code}: {e.reason}", float(named) if named.replace(".", "", 1).isdigit() else None) from e

    def chat(self, system: str, user: str) -> str:
        return self.post({"messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}).get("content") or ""

    def tool(self, system: str, user: str, tool: dict) -> dict:
        """Arguments of the tool, which the model must call; {} if it didn't."""
        name = {"type": "function", "function": {"name": tool["function"]["name"]}}
        calls = self.post({"messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "tools": [tool], "tool_choice": name}).get("tool_calls")
        return json.loads(calls[0]["function"]["arguments"]) if calls else {}


def chat_model(endpoint: Endpoint, system: str, rule: Retries | None = None) -> Callable[[], TextModel]:
    """A factory for asked(): a reply for each text, None where the endpoint refused or gave up, so that one text never fails a task."""

    def one(text: str) -> str | None:
        try:
            return persistent(lambda: endpoint.chat(system, text), rule or Retries())
        except (Refused, GaveUp):
            return None

    return lambda: lambda texts: [one(t) for t in texts]


def tool_model(endpoint: Endpoint, system: str, tool: dict, rule: Retries | None = None) -> Callable[[], TextModel]:
    """The same for a tool's arguments, as JSON: an empty object is asked for again, an empty list in it is an answer."""

    def one(text: str) -> str | None:
        try:
            return json.dumps(persistent(lambda: endpoint.tool(system, text, tool), rule or Retries(), keep_empty=False))
        except (Refused, GaveUp):
            return None

    return lambda: lambda texts: [one(t) for t in texts]


def pattern_replies(queries: DataFrame, cache: DataFrame, factory: Callable[[], TextModel]) -> DataFrame:
    """(qid, reply) of the queries that the cache has no reply for: what is to be appended to it. A query that fails has no row, and is asked again next time."""
    new = asked(replies_todo(queries, cache), "text", "reply", factory).select("qid", strip(without_thinking(F.col("reply"))).alias("reply"))
    return new.where("reply <> ''")


def write_through(queries: DataFrame, path: str, factory: Callable[[], TextModel], block: int = 1000) -> None:
    """Fills the cache at path, block by block in order of qid: what has been answered stays if a later block fails; queries that fail are passed over."""
    spark = queries.sparkSession
    have = spark.read.schema(queries.select("qid", F.lit("").alias("reply")).schema).parquet(path)
    todo = stored(replies_todo(queries, have), "queries-todo")
    last = None
    while True:
        part = (todo if last is None else todo.where(F.col("qid") > F.lit(last))).orderBy("qid").limit(block)
        last = part.agg(F.max("qid")).first()[0]
        if last is None:
            return
        pattern_replies(part, have.limit(0), factory).write.mode("append").parquet(path)
