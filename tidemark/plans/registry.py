"""Registered queries: a Spark plan over the given tables and, where SQL can say it, its ANSI twin."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import tune
from tidemark.plans.cte import with_ctes
from tidemark.plans.standins import Lake


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    plan: Callable[[Lake], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return self.plan(Lake(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register the decorated plan under its function name; `covers` lists the operator ids it shows."""

    def add(plan: Callable[[Lake], DataFrame]):
        key = name or plan.__name__
        assert key not in REGISTRY, key
        REGISTRY[key] = Query(key, covers, plan, with_ctes(sql) if sql else None)
        return plan

    return add


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for output; everything else untouched."""
    def cell(name: str, kind: str) -> Column:
        return F.round(F.col(name), digits).alias(name) if kind == "double" and name not in keep else F.col(name)

    return df.select(*[cell(n, k) for n, k in df.dtypes])


def r(columns: list[str] | str, digits: int = 6, source: str = "") -> str:
    """SQL list `round(c, digits) AS c` for the twins."""
    names = columns.split() if isinstance(columns, str) else columns
    dot = f"{source}." if source else ""
    return ", ".join(f"round({dot}{c}, {digits}) AS {c}" for c in names)
