"""The audit log of incremental runs, an append-only table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import watermark

_SCHEMA = f"{watermark.AUDIT_SCHEMA}, {watermark.STAGED_VERSION} bigint"


@dataclass(frozen=True)
class AuditLog:
    """One entry when a run starts and one when it ends; entries are never changed."""

    spark: SparkSession
    path: str

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(_SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], _SCHEMA)

    def runs(self) -> DataFrame:
        """The current state of each run."""
        return watermark.run_states(self.entries())

    def last_watermark(self) -> dt.datetime | None:
        return watermark.latest_watermark(self.runs()).first()[0]

    def last_version(self) -> int | None:
        """The staging version that the last good run has read up to."""
        return watermark.latest_version(self.runs()).first()[0]

    def _add(self, *values: object) -> None:
        row = self.spark.createDataFrame([values], _SCHEMA)
        row.coalesce(1).write.mode("append").parquet(self.path)

    def start(self, began: dt.datetime, last: dt.datetime | None) -> int:
        run = (self.entries().agg(F.max("id")).first()[0] or 0) + 1
        self._add(run, began, None, last, None, watermark.RUNNING, None, None, None)
        return run

    def close(
        self,
        run: int,
        began: dt.datetime,
        last: dt.datetime | None,
        ended: dt.datetime,
        state: str,
        rows: int,
        message: str | None = None,
        version: int | None = None,
    ) -> None:
        """The start time of the run becomes the watermark of the next one."""
        self._add(run, began, ended, last, began, state, rows, message, version)
