"""All queries of the library proper with their SQL twins, gathered from the modules that define them."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import small_batches

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query]
    sql: dict[str, str]

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: register a query under ``name``, with the SQL that must give the same rows where there is one."""

        def put(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is there already")

            @functools.wraps(query)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                small_batches(spark)
                return query(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return query

        return put


REGISTRY = Registry({}, {})


def shared(name: str, sql: str, duck: str | None = None) -> None:
    """Register a query that is plain SQL in both engines. Tables are named in braces; ``duck`` replaces the twin where dialects differ."""
    import re

    from ..sources.tables import table

    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})

    query.__name__ = name
    REGISTRY.add(name, re.sub(r"\{(\w+)\}", r"\1", duck or sql))(query)
