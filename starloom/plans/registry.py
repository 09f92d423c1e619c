"""Named queries over a folder of Parquet tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from starloom.session import configure


@dataclass(frozen=True)
class Tables:
    """The tables of one folder as attributes: ``tables.orders``."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass
class Registry:
    builders: dict[str, Callable[[Tables], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None):
        """Register a builder under ``name``, with the SQL that gives the same rows."""

        def add(build: Callable[[Tables], DataFrame]):
            if name in self.builders:
                raise ValueError(f"query {name!r} is registered twice")
            self.builders[name] = build
            if sql is not None:
                self.sql[name] = sql
            return build

        return add

    def callables(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(build):
            return lambda spark, folder: build(Tables(configure(spark), folder))

        return {name: bind(build) for name, build in self.builders.items()}


REGISTRY = Registry()


@cache
def load_all() -> Registry:
    """The registry with every query module imported."""
    from starloom.plans import (  # noqa: F401
        queries_cleaning,
        queries_dedupe,
        queries_pipeline,
        queries_quality,
        queries_state,
        queries_university,
        queries_warehouse,
    )

    return REGISTRY
