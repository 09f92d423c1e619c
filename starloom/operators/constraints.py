"""Rules of tables that are declared once and checked on what a run has touched.

Parquet enforces nothing, so the rules of the warehouse are checked before its new state is
published. Only touched rows are looked at: a repeated key has to be among their keys, and a
missing parent can only be missed by one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.joins import drop_matching, keep_matching

VIOLATIONS = "tabla string, regla string, clave string, filas bigint"
# Reads the rows of a table that can have one of some keys.
Reader = Callable[[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Unique:
    """No two rows with the same values; with ``where`` only rows that meet a condition count."""

    table: str
    columns: tuple[str, ...]
    where: str = "true"

    def violations(self, touched: DataFrame, read: Reader) -> DataFrame:
        columns = list(self.columns)
        keys = touched.where(self.where).select(*columns).dropna()
        rows = keep_matching(read(self.table, keys).where(self.where).select(*columns), keys, columns)
        return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("filas")).where("filas > 1")

    @property
    def rule(self) -> str:
        return f"unica({', '.join(self.columns)})"


@dataclass(frozen=True)
class References:
    """Every value that is not null exists in another table."""

    table: str
    columns: tuple[str, ...]
    other: str
    other_columns: tuple[str, ...]

    def violations(self, touched: DataFrame, read: Reader) -> DataFrame:
        columns = list(self.columns)
        keys = touched.select(*columns).dropna()
        parents = read(self.other, keys.toDF(*self.other_columns)).select(*self.other_columns).toDF(*columns)
        # Counted first, so that a key moves once and not once per row.
        return drop_matching(keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("filas")), parents, columns)

    @property
    def rule(self) -> str:
        return f"existe({', '.join(self.columns)} en {self.other})"


@dataclass(frozen=True)
class Holds:
    """A condition that no row may fail; a null outcome passes, as in a SQL check."""

    table: str
    columns: tuple[str, ...]
    condition: str

    def violations(self, touched: DataFrame, read: Reader) -> DataFrame:
        return touched.where(f"not ({self.condition})").groupBy(*self.columns).agg(F.count(F.lit(1)).alias("filas"))

    @property
    def rule(self) -> str:
        return f"cumple({self.condition})"


Constraint = Unique | References | Holds


def violations(constraints: Sequence[Constraint], touched: Mapping[str, DataFrame], read: Reader, empty: DataFrame) -> DataFrame:
    """Broken rules: one row per table, rule and offending key, with its number of rows.

    ``touched`` has the new rows of the tables that changed; rules of other tables are not checked.
    ``empty`` is a frame of the form ``VIOLATIONS``, for runs that touch nothing.
    """
    found = [empty]
    for constraint in constraints:
        if constraint.table in touched:
            key = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in constraint.columns])
            broken = constraint.violations(touched[constraint.table], read)
            found.append(broken.select(F.lit(constraint.table).alias("tabla"), F.lit(constraint.rule).alias("regla"), key.alias("clave"), "filas"))
    return reduce(DataFrame.unionByName, found)
