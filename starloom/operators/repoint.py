"""Stored rows that follow an identity to its new canonical id."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.dedupe import KEPT_ID, REPEATED_ID, keep_one
from starloom.operators.groups import AFTER
from starloom.operators.joins import drop_matching, keep_matching, skew_safe_join
from starloom.session import materialize


def follow_chains(changes: DataFrame, id_map: DataFrame) -> DataFrame:
    """Changed ids with the end of their chain as ``despues``: ``9 -> 5`` in a map with ``5 -> 3`` becomes ``9 -> 3``.

    Only the changed ids are carried from round to round; ids fall along a chain, so it ends.
    """
    onward = id_map.select(F.col(REPEATED_ID).alias(AFTER), F.col(KEPT_ID).alias("_next")).where(F.col("_next") < F.col(AFTER))
    while True:
        moved = materialize(skew_safe_join(changes, onward, [AFTER], "left"))
        changes = moved.withColumn(AFTER, F.coalesce("_next", AFTER)).drop("_next")
        if moved.where("_next is not null").isEmpty():
            return changes


def key_changes(dimension: DataFrame, changes: DataFrame, natural: str, surrogate: str) -> DataFrame:
    """``clave``, ``clave_nueva``, ``id`` and ``despues``: surrogate keys of all versions of a changed id, and the current key of its canonical id.

    An id that is not in the dimension has no key to change; without a current row of the canonical
    id ``clave_nueva`` is null.
    """
    old = dimension.select(F.col(natural).alias("id"), F.col(surrogate).alias("clave"))
    current = dimension.where("es_actual").select(F.col(natural).alias(AFTER), F.col(surrogate).alias("clave_nueva"))
    asked = changes.select("id", AFTER)
    found = keep_matching(old, asked, ["id"]).join(asked, "id")
    return found.join(keep_matching(current, asked, [AFTER]), AFTER, "left").select("clave", "clave_nueva", "id", AFTER)


@dataclass(frozen=True)
class Repointed:
    """Rows of a fact under their new keys, and those that would repeat a unique key and stay."""

    moved: DataFrame
    blocked: DataFrame


def repoint(fact: DataFrame, changed: DataFrame, column: str, unique: Sequence[str], surrogate: str) -> Repointed:
    """Rows of ``fact`` with a changed key in ``column``, split by whether the new key is free.

    Of several rows that would take one unique key the one with the smallest ``surrogate`` moves.
    """
    known = changed.where("clave_nueva is not null").select(F.col("clave").alias(column), "clave_nueva")
    hits = materialize(keep_matching(fact, known, [column]).join(known, column))
    renamed = hits.withColumn("_old", F.col(column)).withColumn(column, F.col("clave_nueva")).drop("clave_nueva")
    if unique:
        taken = keep_matching(fact.select(*unique), renamed, unique)
        free = keep_one(drop_matching(renamed, taken, unique), unique, [surrogate])
    else:
        free = renamed
    moved = materialize(free.select(*fact.columns))
    return Repointed(moved, drop_matching(hits.select(*fact.columns), moved, [surrogate]))


def close_versions(dimension: DataFrame, ids: DataFrame, natural: str, as_of: dt.date) -> DataFrame:
    """All versions, with the current one of the given ids closed."""
    gone = ids.select(natural).distinct().withColumn("_gone", F.lit(True))
    closes = F.col("es_actual") & F.coalesce("_gone", F.lit(False))
    closed = skew_safe_join(dimension, gone, [natural], "left").withColumns(
        {"valid_to": F.when(closes, F.lit(as_of)).otherwise(F.col("valid_to")), "es_actual": F.col("es_actual") & ~closes}
    )
    return closed.select(*dimension.columns)
