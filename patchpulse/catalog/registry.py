"""Registry of named queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(fn):
        REGISTRY[fn.__name__] = Query(fn.__name__, ids, fn, sql)
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six digits, nudged off exact ties so that the last bits of a float sum do not decide the rounding."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6)


def iso(c: Column | str) -> Column:
    """Second-resolution UTC text."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
