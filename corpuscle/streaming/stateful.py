"""Stateful operators: the rules as plain steps, run over batches by key and over streams with managed state.

Each rule is a class with ``step`` (one event in, outputs out) and a state of plain values, so that batch replay and stream
processing share it. Batch replay sorts a key's events and folds them; a key is one session, client or service.
"""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class TokenBuffer:
    """The first token leaves at once; then ``size`` tokens, or what has gathered when ``timeout_ms`` have passed."""

    size: int = 10
    timeout_ms: float = 100.0
    started: bool = False
    last_ms: float = 0.0
    held: list[str] = field(default_factory=list)

    def step(self, token: str, ms: float) -> str | None:
        if not self.started:
            self.started, self.last_ms = True, ms
            return token
        self.held.append(token)
        if len(self.held) >= self.size or ms - self.last_ms >= self.timeout_ms:
            return self.flush(ms)
        return None

    def flush(self, ms: float) -> str | None:
        out, self.held, self.last_ms = "".join(self.held), [], ms
        return out or None


@dataclass
class AdaptiveSize:
    """Buffer size from the mean of the last 50 latencies, from ten on: over 300 ms two more, under 100 ms one less.

    Missing latencies count as seen but not in the mean. The mean is taken to 9 digits, so that one that lies on a limit is not put beside
    it by the sum's last bits.
    """

    size: int = 1
    least: int = 1
    most: int = 10
    seen: list[float | None] = field(default_factory=list)

    def step(self, latency: float | None) -> int:
        self.seen = [*self.seen, latency][-50:]
        known = [x for x in self.seen if x is not None and not math.isnan(x)]
        if len(self.seen) >= 10 and known:
            mean = round(sum(known) / len(known), 9)
            if mean > 300:
                self.size = min(self.most, self.size + 2)
            elif mean < 100:
                self.size = max(self.least, self.size - 1)
        return self.size


@dataclass
class CircuitBreaker:
    """Opens after ``failures`` in a row, tries again after ``wait`` seconds, closes after ``successes``."""

    failures: int = 5
    wait: float = 60.0
    successes: int = 2
    state: str = "closed"
    count: int = 0
    opened: float = 0.0

    def step(self, ok: bool, now: float) -> str:
        if self.state == "open":
            if now - self.opened < self.wait:
                return "rejected"
            self.state, self.count = "half_open", 0
        if self.state == "half_open":
            self.count = self.count + 1 if ok else 0
            if not ok:
                self.state, self.opened = "open", now
            elif self.count >= self.successes:
                self.state, self.count = "closed", 0
        else:
            self.count = 0 if ok else self.count + 1
            if self.count >= self.failures:
                self.state, self.opened = "open", now
        return self.state


@dataclass
class LruTtlCache:
    """Keys in order of use, at most ``size``, each for ``ttl`` seconds; step tells a hit, a miss or an expired entry."""

    size: int = 1000
    ttl: float = 3600.0
    entries: OrderedDict = field(default_factory=OrderedDict)

    def step(self, key: object, now: float) -> str:
        made = self.entries.get(key)
        if made is not None and now - made <= self.ttl:
            self.entries.move_to_end(key)
            return "hit"
        self.entries.pop(key, None)
        self.entries[key] = now
        if len(self.entries) > self.size:
            self.entries.popitem(last=False)
        return "miss" if made is None else "expired"


def replay(df: DataFrame, key: str, order: list[str], columns: list[str], make: type, outcome: str = "outcome", keep: list[str] | None = None) -> DataFrame:
    """Fold each key's events in order through a rule; every event with the rule's outcome as text (null where it held back).

    A rule with a ``flush`` gives what it holds at the end of a key, as the outcome of the key's last event.
    """
    keep = keep or order
    kinds = dict(df.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        rule = make()
        said = [rule.step(*row) for row in part[columns].itertuples(index=False, name=None)]
        if said and said[-1] is None and hasattr(rule, "flush"):
            said[-1] = rule.flush(rule.last_ms)  # what the rule still holds leaves with the key's last event
        return part[list(dict.fromkeys([key, *keep]))].assign(**{outcome: [None if s is None else str(s) for s in said]})

    fields = ", ".join(f"{c} {kinds[c]}" for c in dict.fromkeys([key, *keep]))
    return df.groupBy(key).applyInPandas(run, f"{fields}, {outcome} string")


def bounded_response(df: DataFrame, key: str, order: str, text: str, limit: int = 100_000) -> DataFrame:
    """key, chunks, chars: what a response of bounded size holds after all its chunks came in order.

    A chunk that would take it over the limit first drops the oldest ones until 80 % of the limit are left; then it is added.
    """
    from pyspark.sql import functions as F

    sizes = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.length(text).alias("n")))).alias("_l"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    kept = lambda a: F.filter(a, lambda v, i: total(F.slice(a, i + 1, F.greatest(F.size(a), F.lit(1)))) <= F.lit(limit * 0.8))  # noqa: E731  a suffix
    step = lambda a, x: F.concat(F.when(total(a) + x["n"] > limit, kept(a)).otherwise(a), F.array(x["n"]))
    held = sizes.select(key, F.aggregate("_l", F.array().cast("array<int>"), step).alias("_h"))
    return held.select(key, F.size("_h").cast("bigint").alias("chunks"), total(F.col("_h")).cast("bigint").alias("chars"))


def stream_tokens(stream: DataFrame, key: str = "stream_id", size: int = 10, timeout_ms: float = 100.0, idle_flush: bool = True) -> DataFrame:
    """A stream of (key, seq, token, ms) as flushed chunks (key, chunk); state survives restarts in the state store.

    With ``idle_flush`` a processing-time timer flushes a key that falls silent, so such a query never runs out of work;
    without it the query holds back the last tokens of a key, and ends where its trigger ends.
    """

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rule = TokenBuffer(size, timeout_ms)
        if state.exists:
            rule = TokenBuffer(**json.loads(state.get[0]))
        rows = pd.concat(list(parts)).sort_values("seq") if not state.hasTimedOut else pd.DataFrame({"token": [], "ms": []})
        out = [c for t, ms in zip(rows["token"], rows["ms"], strict=True) if (c := rule.step(t, ms)) is not None]
        if state.hasTimedOut:
            out += [c for c in [rule.flush(rule.last_ms)] if c]
            state.remove()
        else:
            state.update((json.dumps(asdict(rule)),))
            if idle_flush:
                state.setTimeoutDuration(max(1, int(timeout_ms)))
        yield pd.DataFrame({key: [keys[0]] * len(out), "chunk": out})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, chunk string", "rule string", "append", "ProcessingTimeTimeout" if idle_flush else "NoTimeout")


def stream_sessions(stream: DataFrame, key: str, time: str, idle_seconds: int = 3600) -> DataFrame:
    """Sessions of a stream with event time: a gap of more than ``idle_seconds`` ends one; the watermark bounds the state."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, f"{idle_seconds} seconds").groupBy(key, F.session_window(time, f"{idle_seconds} seconds")).agg(F.count(F.lit(1)).alias("events")).select(key, "session_window.start", "session_window.end", "events")


def stream_dedup(stream: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """First rows of each key within the watermark: the dedup whose memory lasts across batches."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
