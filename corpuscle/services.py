"""Extension points of a running service: event handlers, caches, retries and recovery, tracking, notification channels."""

from __future__ import annotations

import functools
import logging
import random
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .sources.stores import Store

log = logging.getLogger(__name__)


class EventHandlers:
    """Callbacks for batches of events; one that fails is logged and stops neither the stream nor the others."""

    def __init__(self) -> None:
        self.handlers: list[Callable[[DataFrame], None]] = []
        self.failures = 0

    def register(self, handler: Callable[[DataFrame], None]) -> None:
        self.handlers.append(handler)

    def unregister(self, handler: Callable[[DataFrame], None]) -> None:
        if handler in self.handlers:
            self.handlers.remove(handler)

    def emit(self, events: DataFrame, batch: int = 0) -> None:
        """Also what ``writeStream.foreachBatch`` takes."""
        for handler in list(self.handlers):
            try:
                handler(events)
            except Exception:  # noqa: BLE001  a handler's failure is its own
                self.failures += 1
                log.exception("an event handler failed in batch %s", batch)


class CacheBackend(Protocol):
    """A cache over rows of key, value: lookups join, so that a batch of keys is one query."""

    def get(self, keys: DataFrame) -> DataFrame: ...

    def put(self, rows: DataFrame, now: float, ttl: float = 0) -> None: ...

    def delete(self, keys: DataFrame) -> None: ...

    def clear(self) -> None: ...

    def stats(self) -> dict[str, int]: ...


class TableCache:
    """A cache as a store of Parquet parts: the last entry of a key counts, a deletion is an entry without a value, ttl 0 never ends.

    Opening one that is there goes on with it. ``compact`` writes what is live as one part, so that reads do not grow with the writes.
    """

    SCHEMA = "key string, value string, at double, ttl double, number bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)

    def _append(self, rows: DataFrame, kind: str = "add", covers: list[str] | None = None) -> None:
        number = max((int(r["figures"].get("number", 0)) for r in self.store.log()), default=0) + 1
        folder = self.store.folder()
        self.store.write(rows.withColumn("number", F.lit(number).cast("bigint")).select("key", "value", "at", "ttl", "number"), folder, "entries")
        self.store.commit(folder, kind, folder, covers, {"number": number})

    def _all(self) -> list[str]:
        return sorted({c for r in self.store.live() for c in (r["entry"], *r["covers"])})

    def live(self, now: float) -> DataFrame:
        newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("number"), F.desc("at"), "value"))
        rows = self.store.part("entries", self.SCHEMA).withColumn("_k", newest).where("_k = 1 and value is not null").drop("_k")
        return rows.where((F.col("ttl") <= 0) | (F.lit(now) - F.col("at") <= F.col("ttl")))

    def get(self, keys: DataFrame, now: float | None = None) -> DataFrame:
        """The keys with value, null where the cache has none."""
        held = self.live(time.time() if now is None else now).select("key", "value")
        return keys.select("key").distinct().join(held, "key", "left")

    def put(self, rows: DataFrame, now: float | None = None, ttl: float = 0) -> None:
        self._append(rows.select("key", "value", F.lit(time.time() if now is None else now).cast("double").alias("at"), F.lit(float(ttl)).alias("ttl")))

    def delete(self, keys: DataFrame) -> None:
        self._append(keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("at"), F.lit(0.0).alias("ttl")))

    def clear(self) -> None:
        self._append(self.spark.createDataFrame([], self.SCHEMA), "clear", self._all())

    def compact(self, now: float | None = None) -> None:
        covers = self._all()
        self._append(self.live(time.time() if now is None else now).drop("number"), "compact", covers)

    def stats(self, now: float | None = None) -> dict[str, int]:
        told = self.live(time.time() if now is None else now).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes")).first()
        return {"entries": told["entries"], "bytes": told["bytes"]}


@dataclass
class RetryPolicy:
    """Attempts with exponential waits, at most ``longest`` seconds, spread by ``jitter``; only errors of ``on`` are tried again.

    For what the driver calls; a task's failure is Spark's to retry.
    """

    attempts: int = 3
    wait: float = 0.1
    factor: float = 2.0
    longest: float = 10.0
    jitter: float = 0.0
    on: tuple[type[BaseException], ...] = (Exception,)
    sleep: Callable[[float], None] = time.sleep

    def delay(self, attempt: int) -> float:
        return min(self.longest, self.wait * self.factor**attempt) * (1 + self.jitter * random.random())

    def call(self, function: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        for attempt in range(self.attempts):
            try:
                return function(*args, **kwargs)
            except self.on:
                if attempt + 1 >= self.attempts:
                    raise
                self.sleep(self.delay(attempt))
        raise ValueError("a retry policy needs one attempt at least")


@dataclass
class RecoveryChain:
    """A call, and what is tried in order when it fails; the first strategy that does not fail gives the result."""

    strategies: list[Callable[[Exception], Any]] = field(default_factory=list)
    history: list[tuple[float, str]] = field(default_factory=list)

    def call(self, function: Callable[[], Any]) -> Any:
        try:
            return function()
        except Exception as error:  # noqa: BLE001
            self.history.append((time.time(), f"{type(error).__name__}: {error}"))
            for strategy in self.strategies:
                try:
                    return strategy(error)
                except Exception as other:  # noqa: BLE001
                    self.history.append((time.time(), f"{type(other).__name__}: {other}"))
            raise

    def errors(self, hours: float = 1.0) -> list[str]:
        return [what for at, what in self.history if at >= time.time() - 3600 * hours]


def tracked(name: str, record: Callable[[str, float, bool], None]) -> Callable:
    """Decorator: ``record`` gets the name, the seconds and whether the call succeeded."""

    def wrap(function: Callable) -> Callable:
        @functools.wraps(function)
        def run(*args: Any, **kwargs: Any) -> Any:
            begun, good = time.perf_counter(), False
            try:
                out = function(*args, **kwargs)
                good = True
                return out
            finally:
                record(name, time.perf_counter() - begun, good)

        return run

    return wrap


def observed(df: DataFrame, name: str, *values: str) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of their number and the sums of some columns, there when an action has run."""
    told = Observation(name)
    return df.observe(told, F.count(F.lit(1)).alias("rows"), *[F.sum(v).alias(f"sum_{v}") for v in values]), told


class NotificationChannel:
    """A channel to subclass: ``send`` delivers one message; ``most`` messages a window of ``seconds`` go out, others count as held back."""

    def __init__(self, name: str, least: int = 0, most: int = 100, seconds: float = 60.0) -> None:
        self.name, self.least, self.most, self.seconds = name, least, most, seconds
        self.times: list[float] = []
        self.counts = {"sent": 0, "failed": 0, "held": 0}

    def send(self, message: dict[str, Any]) -> bool:
        raise NotImplementedError

    def offer(self, message: dict[str, Any], now: float) -> bool:
        if message.get("severity", 0) < self.least:
            return False
        self.times = [t for t in self.times if now - t < self.seconds]
        if len(self.times) >= self.most:
            self.counts["held"] += 1
            return False
        try:
            good = bool(self.send(message))
        except Exception:  # noqa: BLE001  a channel's failure is counted
            good = False
        self.counts["sent" if good else "failed"] += 1
        if good:
            self.times.append(now)
        return good


def notify(alerts: DataFrame, channels: Iterable[NotificationChannel]) -> dict[str, dict[str, int]]:
    """Offer all alerts (severity, at, message) to each channel, in order of time; the channels' counts.

    Alerts reach the driver one partition at a time, and what no channel takes, for its severity, is left out before.
    """
    channels = list(channels)
    taken = alerts.where(F.col("severity") >= min((c.least for c in channels), default=0))
    for row in taken.orderBy("at", "message").toLocalIterator():
        for channel in channels:
            channel.offer(row.asDict(), row["at"])
    return {c.name: dict(c.counts) for c in channels}
