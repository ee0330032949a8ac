"""A registered query: a function of (spark, sf_dir), and the same in SQL where that is possible."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def registered(entries: dict[str, Entry], sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        entries[fn.__name__] = Entry(fn, sql)
        return fn

    return add
