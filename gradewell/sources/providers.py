"""Calls of model services: a rate for each model, retries by kind of failure, and runs that go on where they stopped.

A provider is a function (model_id, prompt) -> text. Prompts of a model are dealt to as many tasks (lanes) as its limit says, and a token
bucket in each gives the lane its share of the rate; retries take tokens too. Answers are written part by part, so a run that
is started again asks only for keys that no written part has: of what was asked, at most the part in hand is lost.

Edge cases: null prompts are asked as empty ones; keys that repeat are asked once each time they stand; a model without a limit is dealt over all tasks
and not held back; no prompts give no rows. Any exception of a provider is a row; what is no Exception (a kill) ends the task.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.sources.shared import settled

KEYS = ("question_set", "model_id", "row_id")
ANSWER = "resps string, success boolean, outcome string, error string, attempts int"


class RateLimited(Exception):
    """The service asks for fewer calls; after: seconds that it wants to pass."""

    def __init__(self, message: str = "", after: float = 0.0):
        super().__init__(message)
        self.after = after


class Refused(Exception):
    """The service will not answer this prompt, however often it is asked."""


@dataclass(frozen=True)
class Limit:
    """Calls a minute over all lanes, how many of them may come at once in a lane, and seconds that pass after each."""

    per_minute: float
    lanes: int = 1
    burst: int = 1
    pause: float = 0.0


@dataclass(frozen=True)
class Retry:
    """Attempts in all; seconds before the second, growing by factor up to longest."""

    attempts: int = 5
    first: float = 1.0
    factor: float = 2.0
    longest: float = 60.0

    def wait(self, attempt: int, error: Exception) -> float:
        return max(min(self.first * self.factor ** (attempt - 1), self.longest), getattr(error, "after", 0.0))


class Clock:
    """The time of calls; a test brings its own."""

    def now(self) -> float:
        return time.monotonic()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class Bucket:
    """Tokens that come at an even rate; take() waits for one."""

    def __init__(self, per_second: float, burst: int, clock: Clock):
        self.rate, self.most, self.clock = per_second, burst, clock
        self.held, self.at = float(burst), clock.now()

    def take(self) -> None:
        self._fill()
        if self.held < 1:
            self.clock.sleep((1 - self.held) / self.rate)
            self._fill()
            self.held = max(self.held, 1.0)  # a wait may end a rounding error early
        self.held -= 1

    def _fill(self) -> None:
        now = self.clock.now()
        self.held, self.at = min(self.most, self.held + (now - self.at) * self.rate), now


def outcome_of(error: Exception) -> str:
    return "rate_limited" if isinstance(error, RateLimited) else "refused" if isinstance(error, Refused) else "timed_out" if isinstance(error, TimeoutError) else "failed"


def call(provider: Callable[[str, str], str], model: str, prompt: str, retry: Retry, clock: Clock, bucket: Bucket | None = None) -> dict:
    """One prompt until it is answered, refused, or asked often enough."""
    for attempt in range(1, retry.attempts + 1):
        if bucket:
            bucket.take()
        try:
            return {"resps": provider(model, prompt), "success": True, "outcome": "answered", "error": None, "attempts": attempt}
        except Exception as e:  # noqa: BLE001 - any failure of a provider is a row
            last = {"resps": "", "success": False, "outcome": outcome_of(e), "error": f"{type(e).__name__}: {e}", "attempts": attempt}
            if isinstance(e, Refused) or attempt == retry.attempts:
                break
            clock.sleep(retry.wait(attempt, e))
    return last


def answer(prompts: DataFrame, provider: Callable[[str, str], str], keys: Sequence[str] = KEYS, limits: Mapping[str, Limit] | None = None, retry: Retry = Retry(), clock: Clock | None = None) -> DataFrame:
    """keys, resps, success, outcome (answered, refused, rate_limited, timed_out or failed), error and attempts of every prompt.

    Calls cost money: write the result before using it, or see answer_into().
    """
    limits, clock = dict(limits or {}), clock or Clock()
    kinds = dict(prompts.dtypes)
    asked = prompts.select(*keys, F.coalesce("prompt", F.lit("")).alias("prompt"))
    places, begun = {}, 0
    for m, limit in limits.items():
        places[m], begun = begun, begun + limit.lanes
    if limits:
        free = max(1, int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        lane = F.lit(begun) + F.pmod(F.xxhash64(*keys), F.lit(free))
        for m, limit in limits.items():
            lane = F.when(F.col("model_id") == m, F.lit(places[m]) + F.pmod(F.xxhash64(*keys), F.lit(limit.lanes))).otherwise(lane)
        asked = asked.repartitionById(begun + free, lane.cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task is one lane: it meets one limited model, or models without limits
        buckets = {}
        for batch in batches:
            said = []
            for model, prompt in zip(batch["model_id"], batch["prompt"], strict=True):
                limit = limits.get(model)
                if limit and model not in buckets:
                    buckets[model] = Bucket(limit.per_minute / 60 / limit.lanes, limit.burst, clock)
                said.append(call(provider, model, prompt, retry, clock, buckets.get(model)))
                if limit and limit.pause:
                    clock.sleep(limit.pause)
            found = pd.DataFrame(said, columns=["resps", "success", "outcome", "error", "attempts"], index=batch.index)
            yield pd.concat([batch[list(keys)], found], axis=1)

    return asked.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {ANSWER}")


def answers(spark: SparkSession, path: str, keys: str = "question_set string, model_id string, row_id long") -> DataFrame:
    """What has been written so far: of several answers to a key one, a good one if there is any."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{keys}, {ANSWER}")
    rows = spark.read.schema(f"{keys}, {ANSWER}").parquet(path)
    told = [c.split()[0] for c in ANSWER.split(", ")]
    names = [c for c in rows.columns if c not in told]
    best = F.max(F.struct("success", *[c for c in told if c != "success"])).alias("_a")
    return rows.groupBy(*names).agg(best).select(*[c for c in KEYS if c in names], *[F.col(f"_a.{c}").alias(c) for c in told])


def answer_into(prompts: DataFrame, provider: Callable[[str, str], str], path: str, limits: Mapping[str, Limit] | None = None, retry: Retry = Retry(), clock: Clock | None = None, part_rows: int = 10_000, again: Sequence[str] = ()) -> DataFrame:
    """Ask what path does not have, part by part, each written before the next is asked; answers() of the prompts' keys.

    Failures are answers too; those of an outcome in again are asked once more.
    """
    spark = prompts.sparkSession
    kinds = dict(prompts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in KEYS)
    done = answers(spark, path, schema).where(~F.col("outcome").isin(list(again)) if again else F.lit(True))
    missing = settled(prompts.join(done.select(*KEYS), list(KEYS), "left_anti"))
    parts = math.ceil(missing.count() / part_rows)
    for k in range(parts):
        own = missing.where(F.pmod(F.hash(*KEYS), F.lit(parts)) == k)
        answer(own, provider, limits=limits, retry=retry, clock=clock).write.mode("append").partitionBy("question_set", "model_id").parquet(path)
    return answers(spark, path, schema).join(prompts.select(*KEYS).distinct(), list(KEYS))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Rehearsal(Clock):
    """A clock whose time passes only by waiting, for rehearsals of a run without a service."""

    def __init__(self):
        self.time = 0.0

    def now(self) -> float:
        return self.time

    def sleep(self, seconds: float) -> None:
        self.time += seconds
