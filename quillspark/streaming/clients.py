"""The seam to models: any client that answers prompts, run per partition with retries and a rate limit."""

from __future__ import annotations

import base64
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "output string, prompt_tokens long, completion_tokens long, finish_reason string, error string"


class ModelClient(Protocol):
    def ask(self, prompt: str, images: list[bytes]) -> dict:
        """output, prompt_tokens, completion_tokens, finish_reason."""


@dataclass
class EchoClient:
    """A client without a model: answers with a fixed function of the prompt."""

    answer: Callable[[str], str] = str.upper

    def ask(self, prompt: str, images: list[bytes]) -> dict:
        out = self.answer(prompt)
        return {"output": out, "prompt_tokens": max(1, len(prompt) // 4), "completion_tokens": max(1, len(out) // 4) if out else 0, "finish_reason": "stop"}


@dataclass
class FixedClient:
    """Answers every prompt with one text."""

    text: str

    def ask(self, prompt: str, images: list[bytes]) -> dict:
        return {"output": self.text, "prompt_tokens": max(1, len(prompt) // 4), "completion_tokens": max(1, len(self.text) // 4) if self.text else 0, "finish_reason": "stop"}


@dataclass
class Policy:
    """Retries with growing waits; an empty answer is retried too.

    interval is the least time between the starts of two calls of the whole run, however many tasks it has;
    threads are the calls that a task keeps open at once; serial runs one call after the other in one task,
    with a pause after each."""

    tries: int = 5
    longest_wait: float = 30.0
    interval: float = 0.0
    threads: int = 1
    serial: bool = False
    pause: float = 0.0
    sleep: Callable[[float], None] = field(default=time.sleep)

    def wait(self, attempt: int) -> float:
        return min(self.longest_wait, 2.0 ** (attempt - 1))


def ask_with_retries(client: ModelClient, prompt: str, images: list[bytes], policy: Policy) -> dict:
    """The first answer that is not empty; after the last try the error or an empty answer."""
    error = None
    for attempt in range(1, policy.tries + 1):
        try:
            got = client.ask(prompt, images)
            if got.get("output"):
                return got | {"error": None}
            error = None
        except Exception as e:  # what a client raises is recorded, not hidden
            error = f"{type(e).__name__}: {e}"
        if attempt < policy.tries:
            policy.sleep(policy.wait(attempt))
    return {"output": "", "prompt_tokens": 0, "completion_tokens": 0, "finish_reason": None, "error": error}


class Pace:
    """Starts of calls of one task: its share of the run's rate, beginning at its own turn."""

    def __init__(self, interval: float, tasks: int, task: int, sleep: Callable[[float], None], clock: Callable[[], float] = time.monotonic):
        self.every, self.sleep, self.clock, self.lock = interval * tasks, sleep, clock, threading.Lock()
        self.allowed = clock() + interval * task

    def turn(self) -> None:
        """Wait until the next call may start."""
        if not self.every:
            return
        with self.lock:
            now = self.clock()
            wait = self.allowed - now
            self.allowed = max(now, self.allowed) + self.every
        if wait > 0:
            self.sleep(wait)


def ask_rows(rows: DataFrame, make_client: Callable[[], ModelClient], policy: Policy | None = None, prompt: str = "prompt", images: str | None = None) -> DataFrame:
    """rows with the answer columns added; each task makes its own client and keeps its share of the pace.

    Where a pace is set, there are no more tasks than run at once, so that their shares add up to it."""
    policy = policy or Policy()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + ANSWER
    names = [c.split()[0] for c in ANSWER.split(", ")]
    tasks = 1 if policy.serial else rows.sparkSession.sparkContext.defaultParallelism
    if policy.serial or policy.interval:
        rows = rows.coalesce(tasks)
    threads = 1 if policy.serial else max(1, policy.threads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        pace = Pace(policy.interval, tasks, TaskContext.get().partitionId() % tasks, policy.sleep)

        def one(case):
            pace.turn()
            got = ask_with_retries(client, case[0] or "", list(case[1]), policy)
            if policy.serial and policy.pause:
                policy.sleep(policy.pause)
            return got

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                cases = zip(pdf[prompt], pdf[images] if images else ([] for _ in range(len(pdf))), strict=True)
                made = list(pool.map(one, cases))
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    return rows.mapInPandas(run, schema)


def blocked(finish_reason: Column) -> Column:
    """Whether an answer was stopped by a safety filter."""
    return F.coalesce(F.lower(finish_reason).isin("content_filter", "safety"), F.lit(False))


def data_url(content: bytes, kind: str = "png") -> str:
    return f"data:image/{kind};base64,{base64.b64encode(content).decode()}"
