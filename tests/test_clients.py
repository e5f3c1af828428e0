import sys
import threading
import time

from pyspark.sql import functions as F

from quillspark.streaming import clients


def test_shares_of_tasks_add_up_to_the_pace():
    """Starts of three tasks, each with its own clock that only waiting moves."""
    starts = []
    for task in range(3):
        now = [0.0]
        pace = clients.Pace(2.0, 3, task, lambda s, now=now: now.__setitem__(0, now[0] + s), lambda now=now: now[0])
        for _ in range(4):
            pace.turn()
            starts.append(now[0])
    assert sorted(starts) == [2.0 * i for i in range(12)]


def counting():
    """Made in a function, so that it is shipped to workers by value."""

    class Counting:
        """A client that knows how many calls are open at once."""

        def __init__(self):
            self.open, self.most, self.lock = 0, 0, threading.Lock()

        def ask(self, prompt, images):
            with self.lock:
                self.open += 1
                self.most = max(self.most, self.open)
            time.sleep(0.05)
            with self.lock:
                self.open -= 1
            return {"output": f"{prompt}:{self.most}", "prompt_tokens": 1, "completion_tokens": 1, "finish_reason": "stop"}

    return Counting()


def test_calls_at_once(spark):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = spark.range(0, 24, 1, 2).select(F.col("id").cast("string").alias("prompt"))
    for policy, most in ((clients.Policy(threads=4), 4), (clients.Policy(serial=True, pause=0.001, threads=4), 1)):
        got = clients.ask_rows(rows, lambda: counting(), policy).collect()
        assert sorted(int(r.output.split(":")[0]) for r in got) == list(range(24)) and all(r.output.split(":")[0] == r.prompt for r in got)
        assert max(int(r.output.split(":")[1]) for r in got) == most


def test_a_paced_run(spark):
    rows = spark.range(0, 8, 1, 8).select(F.col("id").cast("string").alias("prompt"))
    start = time.monotonic()
    assert clients.ask_rows(rows, clients.EchoClient, clients.Policy(interval=0.2)).count() == 8
    assert time.monotonic() - start >= 0.2 * 4  # four tasks of two calls: the last starts 0.2 * 4 after its first


def test_safety_stops(spark):
    reasons = spark.createDataFrame([("content_filter",), ("SAFETY",), ("stop",), (None,)], "r string")
    assert [r[0] for r in reasons.select(clients.blocked(F.col("r"))).collect()] == [True, True, False, False]
