"""Where the queries of this folder are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .fixtures import oracle, query, view

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, given or derived, by name; and SQL over them."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        return query(self.spark, self.sf_dir, text)


def add(name: str, make: Callable[[Tables], DataFrame], sql: str | None = None, **more: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(sql, **more)
