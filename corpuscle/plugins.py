"""Extension points: what a user may pass in, with deterministic offline defaults.

Retrievers, scorers, judges, rewriters and generators are functions of DataFrames, so that a plug-in may call a model in
Arrow batches; fallbacks and middleware compose them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import index_tokens
from .operators.retrieval import overlap_score


class Retriever(Protocol):
    def __call__(self, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


class Scorer(Protocol):
    def __call__(self, hits: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def coverage_judge(rows: DataFrame, question: str = "question", context: str = "context", least: float = 0.3) -> DataFrame:
    """Adds relevant: whether the context has at least a share ``least`` of the question's terms; a missing context has not."""
    return rows.withColumn("relevant", F.when(F.col(context).isNull(), F.lit(False)).otherwise(overlap_score(F.col(question), F.col(context)) >= least))


def keyword_rewrite(question: Column, keep: int = 5) -> Column:
    """The longest terms of a question, in order of length and then of the alphabet; a question without terms stays."""
    terms = F.slice(F.array_sort(index_tokens(question), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))), 1, keep)
    return F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(question)


def extractive_answer(question: Column, context: Column, sentences: int = 2) -> Column:
    """The sentences of the context with most of the question's terms, the earlier first among equals."""
    parts = F.filter(F.split(context, r"(?<=[.?!])\s+"), lambda s: F.trim(s) != "")
    scored = F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(index_tokens(question), index_tokens(s)))).alias("n"), i.alias("i"), s.alias("s")))
    return F.array_join(F.transform(F.slice(F.sort_array(scored), 1, sentences), lambda x: x["s"]), " ")


def batched(function: Callable[[list[str]], list], column: str, out: str, kind: str, size: int = 50, on_error: object = None) -> Callable[[DataFrame], DataFrame]:
    """A DataFrame step that calls ``function`` on batches of a text column; a failing batch gives ``on_error``."""

    def step(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                said: list = []
                for i in range(0, len(batch), size):
                    part = batch[column].iloc[i : i + size].tolist()
                    try:
                        said += list(function(part))
                    except Exception:  # noqa: BLE001  the plug-in's failure is the defined result of its batch
                        said += [on_error] * len(part)
                yield batch.assign(**{out: said})

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, f"{fields}, {out} {kind}")

    return step


def first_answer(*steps: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame], DataFrame]:
    """Ordered fallbacks: each step adds ``out``; the first that is not null counts."""

    def step(df: DataFrame) -> DataFrame:
        for i, one in enumerate(steps):
            df = one(df).withColumnRenamed(out, f"_{i}")
        return df.withColumn(out, F.coalesce(*[F.col(f"_{i}") for i in range(len(steps))])).drop(*[f"_{i}" for i in range(len(steps))])

    return step


def stack(*middleware: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps in order as one."""

    def step(df: DataFrame) -> DataFrame:
        for one in middleware:
            df = df.transform(one)
        return df

    return step
