"""Dimension building."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import academic_period, date_key, month_name_es
from starloom.operators.dedupe import keep_one


def distinct_dates(*sources: tuple[DataFrame, str]) -> DataFrame:
    """The distinct non-null dates of several ``(frame, column)`` pairs.

    Each source is reduced on its own before the union, so no source ever sends
    more than one row per date and partition.
    """
    parts = [df.select(F.col(column).cast("date").alias("fecha")).distinct() for df, column in sources]
    return reduce(DataFrame.union, parts).where(F.col("fecha").isNotNull()).distinct()


def calendar_dimension(dates: DataFrame) -> DataFrame:
    """Calendar rows for a frame with one ``fecha`` column of distinct dates."""
    day = F.col("fecha")
    return dates.select(
        date_key(day).alias("tiempoSKey"),
        day,
        F.dayofmonth(day).alias("dia"),
        month_name_es(day).alias("mes"),
        F.year(day).alias("ano"),
        academic_period(day).alias("periodoAcademico"),
        F.lit(False).alias("esFeriado"),
    )


def versioned(df: DataFrame, as_of: dt.date, **constants: Column) -> DataFrame:
    """Add constant attributes and an open validity interval starting on ``as_of``."""
    return df.withColumns(
        {
            **constants,
            "valid_from": F.lit(as_of),
            "valid_to": F.lit(None).cast("date"),
            "es_actual": F.lit(True),
        }
    )


def finish_dimension(
    df: DataFrame, columns: Sequence[str], natural: str, order_by: Sequence[str]
) -> DataFrame:
    """Project to the final columns, one row per natural key."""
    extra = [c for c in order_by if c not in columns]
    return keep_one(df.select(*columns, *extra), [natural], order_by).select(*columns)
