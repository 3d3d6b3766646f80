"""A registry of queries: a function of named tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablekeel.core import Refused


class Tables:
    """Tables of one folder, read when they are named."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):  # noqa: ANN204
        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return f

        return add


def one_row(t: Tables, shape: str, *values: Any) -> DataFrame:
    """What an operator found out about a table, as a row."""
    return t.spark.createDataFrame([values], shape)


def refusal(operator: Callable[..., Any], *args: Any, **kwargs: Any) -> Refused:
    """What an operator refuses with; an error if it does not refuse."""
    try:
        operator(*args, **kwargs)
    except Refused as e:
        return e
    raise AssertionError(f"{operator.__name__} did not refuse")
