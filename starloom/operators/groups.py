"""Duplicate groups as a stored state that small deltas are merged into.

A state is the set of different (group key, id) pairs. Merging is a union of sets, so it may
be repeated and split as one likes. From a delta on, only its own groups are looked at: their
stored pairs give the new smallest ids, and the map of repeated ids changes for ids of these
groups alone. The result is the map that ``dedupe.duplicate_map`` makes of everything seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.dedupe import KEPT_ID, REPEATED_ID, clean_map
from starloom.operators.joins import drop_matching, keep_matching, skew_safe_join
from starloom.session import materialize

BEFORE, AFTER = "antes", "despues"


def group_pairs(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The different pairs of group key and id; rows with a null in either are in no group."""
    return df.select(*keys, id_col).dropna().distinct()


def repeated_in_groups(pairs: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """``keys``, ``id_repetido`` and ``id_tomado`` for every id that is not the smallest of a group.

    Groups of several ids are written down: where they are few, Spark knows it and the pairs stay where they are.
    """
    least = pairs.groupBy(*keys).agg(F.min(id_col).alias(KEPT_ID), F.max(id_col).alias("_largest"))
    shared = materialize(least.where(F.col(KEPT_ID) != F.col("_largest")).drop("_largest"))
    return (
        skew_safe_join(pairs, shared, keys, "inner")
        .where(F.col(id_col) != F.col(KEPT_ID))
        .select(*keys, F.col(id_col).alias(REPEATED_ID), KEPT_ID)
    )


@dataclass(frozen=True)
class GroupUpdate:
    """Pairs a delta adds to a state, and the repeated ids of all groups it touches."""

    new_pairs: DataFrame
    repeated: DataFrame


def merge_groups(stored: DataFrame, delta: DataFrame, keys: Sequence[str], id_col: str) -> GroupUpdate:
    """Merge pairs of a delta into stored pairs; of these only the delta's groups are read on."""
    delta = materialize(delta.distinct())
    known = materialize(keep_matching(stored, delta, keys))
    new = materialize(drop_matching(delta, known, [*keys, id_col]))
    return GroupUpdate(new, materialize(repeated_in_groups(known.unionByName(new), keys, id_col)))


@dataclass(frozen=True)
class MapUpdate:
    """What changes in a map: ids whose entry is decided anew, and the entries they have from now on."""

    ids: DataFrame
    entries: DataFrame

    def only(self, ids: DataFrame) -> MapUpdate:
        """The part of the update that concerns some of its ids."""
        return MapUpdate(ids, keep_matching(self.entries, ids, [REPEATED_ID]))

    def apply(self, id_map: DataFrame) -> DataFrame:
        return drop_matching(id_map, self.ids, [REPEATED_ID]).unionByName(self.entries)

    def changes(self, id_map: DataFrame) -> DataFrame:
        """Canonical ids before and after, of the ids for which they differ."""
        return canonical_changes(keep_matching(id_map, self.ids, [REPEATED_ID]), self.entries)


def update_map(stored: DataFrame, fresh: DataFrame, touched: DataFrame, keys: Sequence[str]) -> MapUpdate:
    """New map entries after the repeated ids of the ``touched`` groups became ``fresh``.

    ``stored`` holds the repeated ids of all groups (``keys``, ``id_repetido``, ``id_tomado``). An
    id of several groups has the smallest canonical id that one of them gives.
    """
    gone = keep_matching(stored, touched, keys)
    ids = materialize(gone.select(REPEATED_ID).unionByName(fresh.select(REPEATED_ID)).distinct())
    elsewhere = drop_matching(keep_matching(stored, ids, [REPEATED_ID]), touched, keys)
    entries = clean_map(elsewhere.select(REPEATED_ID, KEPT_ID).unionByName(fresh.select(REPEATED_ID, KEPT_ID)))
    return MapUpdate(ids, materialize(entries))


def canonical_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id``, ``antes`` and ``despues`` where two maps give an id different canonical ids.

    An id that is in no map is its own canonical id.
    """
    old = before.select(F.col(REPEATED_ID).alias("id"), F.col(KEPT_ID).alias(BEFORE))
    new = after.select(F.col(REPEATED_ID).alias("id"), F.col(KEPT_ID).alias(AFTER))
    both = old.join(new, "id", "full_outer")
    resolved = both.select("id", *[F.coalesce(c, "id").alias(c) for c in (BEFORE, AFTER)])
    return resolved.where(F.col(BEFORE) != F.col(AFTER))


def compact_chains(id_map: DataFrame) -> DataFrame:
    """Every id of a map with the end of its chain: ``9 -> 5`` and ``5 -> 3`` become ``9 -> 3`` and ``5 -> 3``.

    Each round doubles the steps that are taken at once, so the number of rounds grows with the
    logarithm of the longest chain. Canonical ids have to be smaller than the ids they stand for,
    as those of duplicate maps are; anything else could go in circles and is an error.
    """
    links = materialize(clean_map(id_map))
    if not links.where(F.col(KEPT_ID) >= F.col(REPEATED_ID)).isEmpty():
        raise ValueError("a canonical id has to be smaller than the ids it stands for")
    while True:
        onward = links.select(F.col(REPEATED_ID).alias(KEPT_ID), F.col(KEPT_ID).alias("_next"))
        moved = skew_safe_join(links, onward, [KEPT_ID], "left")
        longer = materialize(moved.select(REPEATED_ID, F.coalesce("_next", KEPT_ID).alias(KEPT_ID), F.col("_next").isNotNull().alias("_moved")))
        links = longer.select(REPEATED_ID, KEPT_ID)
        if longer.where("_moved").isEmpty():
            return links
