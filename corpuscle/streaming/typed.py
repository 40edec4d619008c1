"""Typed events of answering sessions as a stream of chunks, numbered within their session.

An event comes from one of three sources: the workflow's own notices (``custom``), a model's tokens (``messages``) and results of
its steps (``updates``). What an event holds becomes a chunk of that kind at once, except for the model's content, which is held back in a
token buffer. The rule is one class; a batch replays each session through it, and a stream keeps it in managed state, with a
timer that ends a session that has fallen silent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import TokenBuffer

EVENT = ("mode", "status", "documents", "thought", "content", "performance", "at_ms")
CHUNK = "chunk_index bigint, at_ms double, kind string, content string, tokens bigint"
#: What each source's events may hold, in the order in which it is told.
TOLD = {"custom": ("status", "documents", "thought", "content"), "messages": ("thought", "content"), "updates": ("documents", "performance")}


@dataclass
class ChunkStream:
    """One session: the number of the next chunk and the buffer of the model's tokens."""

    size: int = 1
    timeout_ms: float = 30.0
    index: int = 0
    buffer: TokenBuffer = field(default_factory=TokenBuffer)

    @classmethod
    def new(cls, size: int, timeout_ms: float) -> ChunkStream:
        return cls(size, timeout_ms, 0, TokenBuffer(size, timeout_ms))

    @classmethod
    def load(cls, text: str) -> ChunkStream:
        known = json.loads(text)
        return cls(**known | {"buffer": TokenBuffer(**known["buffer"])})

    def dump(self) -> str:
        return json.dumps(asdict(self))

    def _chunk(self, kind: str, content: str, at_ms: float, tokens: int = 0) -> tuple:
        self.index += 1
        return (self.index - 1, at_ms, kind, content, tokens)

    def step(self, event: dict) -> list[tuple]:
        """The chunks that an event gives; events of another mode, or that hold nothing, give none."""
        out, at = [], event["at_ms"]
        for kind in TOLD.get(event["mode"], ()):
            said = event[kind]
            if not isinstance(said, str) or not said:
                continue
            if kind != "content":
                out.append(self._chunk(kind, said, at))
            elif event["mode"] == "custom":  # ready text, told as it is
                out.append(self._chunk(kind, said, at, max(1, len(said) // 2)))
            elif held := self.buffer.step(said, at):
                out.append(self._chunk(kind, held, at, max(1, len(held) // 4)))
        return out

    def finish(self, at_ms: float) -> list[tuple]:
        """What is still held back, as the last chunk."""
        held = self.buffer.flush(at_ms)
        return [self._chunk("final", held, at_ms, len(held.split()))] if held else []


def typed(**sources: DataFrame) -> DataFrame:
    """The union of sources by mode: rows of session, seq and at_ms, and what they hold; columns a source lacks are null."""
    out = None
    for mode, rows in sources.items():
        columns = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EVENT[1:-1]]
        some = rows.select("session", F.col("seq").cast("bigint").alias("seq"), F.col("at_ms").cast("double").alias("at_ms"), F.lit(mode).alias("mode"), *columns)
        out = some if out is None else out.unionByName(some)
    return out


def _rows(session: object, chunks: list[tuple]) -> pd.DataFrame:
    kinds = [tuple(f.split()) for f in CHUNK.split(", ")]
    of = {"bigint": "int64", "double": "float64", "string": object}
    columns = {name: pd.Series([c[i] for c in chunks], dtype=of[kind]) for i, (name, kind) in enumerate(kinds)}
    return pd.DataFrame({"session": pd.Series([session] * len(chunks), dtype=object if isinstance(session, str) else None)} | columns)


def replay(events: DataFrame, size: int = 1, timeout_ms: float = 30.0) -> DataFrame:
    """session and the chunks of each session's events in the order of seq; a session is one answer's events."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq", kind="stable")
        rule = ChunkStream.new(size, timeout_ms)
        chunks = [c for event in part[list(EVENT)].to_dict("records") for c in rule.step(event)]
        return _rows(part["session"].iloc[0], chunks + rule.finish(float(part["at_ms"].iloc[-1])))

    return events.groupBy("session").applyInPandas(run, f"session {dict(events.dtypes)['session']}, {CHUNK}")


class Sessions(StatefulProcessor):
    """Keeps a session's rule between batches; ``idle_ms`` after its last event, if given, a session is finished and forgotten."""

    def __init__(self, size: int, timeout_ms: float, idle_ms: int | None):
        self.size, self.timeout_ms, self.idle_ms = size, timeout_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rule = handle.getValueState("rule", "rule string, last_ms double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.rule.get()
        rule = ChunkStream.load(held[0]) if held else ChunkStream.new(self.size, self.timeout_ms)
        part = pd.concat(list(rows)).sort_values("seq", kind="stable")
        chunks = [c for event in part[list(EVENT)].to_dict("records") for c in rule.step(event)]
        self.rule.update((rule.dump(), float(part["at_ms"].iloc[-1])))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _rows(key[0], chunks)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.rule.get()
        if held:
            self.rule.clear()
            yield _rows(key[0], ChunkStream.load(held[0]).finish(held[1]))

    def close(self) -> None:
        pass


def stream_chunks(events: DataFrame, size: int = 1, timeout_ms: float = 30.0, idle_ms: int | None = 10_000) -> DataFrame:
    """The same over a stream of events. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).

    With ``idle_ms`` a query never runs out of work; without it sessions hold back their last tokens, and a query ends where its trigger ends.
    """
    schema = f"session {dict(events.dtypes)['session']}, {CHUNK}"
    return events.groupBy("session").transformWithStateInPandas(Sessions(size, timeout_ms, idle_ms), schema, "Append", "None" if idle_ms is None else "ProcessingTime")


def timing(events: DataFrame) -> DataFrame:
    """session, ttft, thinking, answer, total in milliseconds: to the first content, from the first thought to it, from it to the last event, and all."""
    said = events.groupBy("session").agg(
        F.min("at_ms").alias("_begun"), F.max("at_ms").alias("_ended"), F.min(F.when(F.col("thought") != "", F.col("at_ms"))).alias("_thought"),
        F.min(F.when((F.col("mode") == "messages") & (F.col("content") != ""), F.col("at_ms"))).alias("_first"),
    )
    first, thought = F.col("_first"), F.col("_thought")
    return said.select("session", (first - F.col("_begun")).alias("ttft"), F.greatest(first - thought, F.lit(0.0)).alias("thinking"), (F.col("_ended") - first).alias("answer"), (F.col("_ended") - F.col("_begun")).alias("total"))
