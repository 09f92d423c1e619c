"""Change detection between two versions of a row."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_changed(old: Column, new: Column) -> Column:
    """True when two values differ. Never null.

    Two nulls are the same, one null is a change, and values that read as equal
    numbers are the same whatever their type (``5`` and ``"5.0"``).
    """
    as_number = [c.cast("string").try_cast("double") for c in (old, new)]
    same = old.cast("string").eqNullSafe(new.cast("string")) | F.coalesce(
        as_number[0] == as_number[1], F.lit(False)
    )
    return ~same


def columns_changed(columns: Iterable[str], old_prefix: str) -> Column:
    """True when any column differs from the one of the same name under ``old_prefix``."""
    checks = [value_changed(F.col(old_prefix + name), F.col(name)) for name in columns]
    return reduce(lambda a, b: a | b, checks, F.lit(False))
