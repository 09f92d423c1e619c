"""Delta reads by high-water mark, and the audit log behind it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Run states in the audit log.
RUNNING, OK, ERROR = "RUNNING", "OK", "ERROR"

AUDIT_SCHEMA = (
    "id bigint, inicio timestamp, fin timestamp, ultima_extraccion timestamp, "
    "nueva_extraccion timestamp, estado string, registros_delta bigint, mensaje_error string"
)
# The staging version a run has read up to; a clock could skip rows that are staged meanwhile.
STAGED_VERSION = "version_staging"


def rows_after(df: DataFrame, watermark: dt.datetime, loaded_at: str = "fecha_carga") -> DataFrame:
    """Rows loaded strictly after the watermark. The filter reaches the scan."""
    return df.where(F.col(loaded_at) > F.lit(watermark))


def latest_rows(df: DataFrame, n: int, order_by: str = "row_id") -> DataFrame:
    """The ``n`` rows with the highest order number (top-k, no full sort)."""
    return df.orderBy(F.col(order_by).desc()).limit(n)


def delta(df: DataFrame, watermark: dt.datetime | None) -> DataFrame:
    """Rows after the watermark; without one every row, so that nothing is skipped for good."""
    return df if watermark is None else rows_after(df, watermark)


def run_states(log: DataFrame) -> DataFrame:
    """The last entry of every run of an append-only audit log.

    A closing entry has an end time, the opening one has none.
    """
    entry = F.struct(*[F.col(c) for c in log.columns if c != "id"])
    order = F.coalesce(F.col("fin"), F.lit(dt.datetime(1, 1, 1)))
    return log.groupBy("id").agg(F.max_by(entry, order).alias("_entry")).select("id", "_entry.*")


def latest_watermark(log: DataFrame) -> DataFrame:
    """One row: the watermark of the newest successful run, null without one."""
    return _of_newest_good_run(log, "nueva_extraccion")


def latest_version(log: DataFrame) -> DataFrame:
    """One row: the staging version of the newest successful run, null without one."""
    return _of_newest_good_run(log, STAGED_VERSION)


def _of_newest_good_run(log: DataFrame, column: str) -> DataFrame:
    good = log.where((F.col("estado") == OK) & F.col(column).isNotNull())
    return good.agg(F.max_by(column, "id").alias(column))
