"""The duplicate maps of staging, kept up to date from deltas.

Beside the two maps, staging holds the state they follow from: the pairs of national id and
student, the pairs of enrollment with its student and offering as staged, and the repeated
ids of every group. A run merges its delta and rewrites the parts of the maps it touches; all
of staging is read only when there is no state, or when a staging table was replaced since.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import is_national_id
from starloom.operators.dedupe import KEPT_ID, REPEATED_ID, clean_map, remap
from starloom.operators.groups import (
    AFTER,
    BEFORE,
    canonical_changes,
    group_pairs,
    merge_groups,
    repeated_in_groups,
    update_map,
)
from starloom.operators.joins import keep_matching
from starloom.plans import university as u
from starloom.session import materialize
from starloom.sources.store import TableStore

STUDENT_MAP, ENROLLMENT_MAP = "stg_estudiantes_repetidos", "stg_inscripciones_repetidas"
STUDENT_PAIRS, ENROLLMENT_PAIRS = "stg_pares_estudiantes", "stg_pares_inscripciones"
STUDENT_GROUPS, ENROLLMENT_GROUPS = "stg_grupos_estudiantes", "stg_grupos_inscripciones"
MERGED = "stg_repetidos_hasta"

STATE_SCHEMAS = {
    STUDENT_PAIRS: "dni bigint, id_estudiante bigint",
    ENROLLMENT_PAIRS: "id_estudiante bigint, id_dictado bigint, id_inscripcion bigint",
    STUDENT_GROUPS: "dni bigint, id_repetido bigint, id_tomado bigint",
    ENROLLMENT_GROUPS: "id_estudiante bigint, id_dictado bigint, id_repetido bigint, id_tomado bigint",
    MERGED: "version bigint",
}
BUCKET_KEYS = {
    STUDENT_PAIRS: "dni",
    STUDENT_GROUPS: "dni",
    ENROLLMENT_PAIRS: "id_estudiante",
    ENROLLMENT_GROUPS: "id_estudiante",
    STUDENT_MAP: REPEATED_ID,
    ENROLLMENT_MAP: REPEATED_ID,
}
_PAIR = ["id_estudiante", "id_dictado"]


@dataclass(frozen=True)
class Maps:
    """Both maps as they are now, and the ids of which the canonical id is another than before the run."""

    students: DataFrame
    enrollments: DataFrame
    student_changes: DataFrame
    enrollment_changes: DataFrame
    rebuilt: bool


def student_pairs(raw: DataFrame) -> DataFrame:
    """National ids with the students that have them; only the id columns are read."""
    rows = u.ENTITIES["estudiantes"].typed(raw, ["id_estudiante", "dni"])
    return group_pairs(rows.where(is_national_id(F.col("dni"))), ["dni"], "id_estudiante")


def enrollment_pairs(raw: DataFrame) -> DataFrame:
    """Enrollments with student and offering as staged; only the id columns are read."""
    rows = u.ENTITIES["inscripciones"].typed(raw, ["id_inscripcion", "id_estudiante", "id_dictado"])
    return group_pairs(rows, _PAIR, "id_inscripcion")


def _staged(staging: TableStore, entity: str) -> DataFrame:
    return staging.read(u.staging_name(u.ENTITIES[entity].source))


def rebuild_maps(staging: TableStore) -> Maps:
    """Maps and state from all of staging."""
    before = {table: materialize(staging.read(table)) for table in (STUDENT_MAP, ENROLLMENT_MAP)}
    staging.replace(STUDENT_PAIRS, student_pairs(_staged(staging, "estudiantes")))
    staging.replace(ENROLLMENT_PAIRS, enrollment_pairs(_staged(staging, "inscripciones")))
    staging.replace(STUDENT_GROUPS, repeated_in_groups(staging.read(STUDENT_PAIRS), ["dni"], "id_estudiante"))
    staging.replace(STUDENT_MAP, clean_map(staging.read(STUDENT_GROUPS)))
    canonical = remap(staging.read(ENROLLMENT_PAIRS), staging.read(STUDENT_MAP), "id_estudiante").distinct()
    staging.replace(ENROLLMENT_GROUPS, repeated_in_groups(canonical, _PAIR, "id_inscripcion"))
    staging.replace(ENROLLMENT_MAP, clean_map(staging.read(ENROLLMENT_GROUPS)))
    maps = {table: staging.read(table) for table in before}
    changes = {table: materialize(canonical_changes(before[table], maps[table])) for table in before}
    return Maps(maps[STUDENT_MAP], maps[ENROLLMENT_MAP], changes[STUDENT_MAP], changes[ENROLLMENT_MAP], True)


def _of(staging: TableStore, table: str, keys: DataFrame) -> DataFrame:
    """The rows of the parts that some keys belong to."""
    return staging.read_parts(table, staging.parts_of(table, keys))


def _add(staging: TableStore, table: str, rows: DataFrame) -> None:
    if not rows.isEmpty():
        staging.append(table, rows)


def _store_groups(staging: TableStore, table: str, map_table: str, fresh: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Put the repeated ids of the touched groups in place of the old ones, and change the map; the changes of canonical ids."""
    update = update_map(staging.read(table), fresh, touched, [key])
    if update.ids.isEmpty():
        return canonical_changes(update.entries, update.entries)
    parts = staging.parts_of(table, touched)
    kept = staging.read_parts(table, parts).join(touched, key, "left_anti")
    staging.replace_parts(table, kept.unionByName(fresh), parts)
    changes = materialize(update.changes(_of(staging, map_table, update.ids)))
    if not changes.isEmpty():
        changed = update.only(changes.select(F.col("id").alias(REPEATED_ID)))
        parts = staging.parts_of(map_table, changed.ids)
        staging.replace_parts(map_table, changed.apply(staging.read_parts(map_table, parts)), parts)
    return changes


def merge_deltas(staging: TableStore, deltas: Mapping[str, DataFrame]) -> Maps:
    """Maps and state after the staged rows of a delta.

    A changed canonical student takes all enrollments of that student to another group, so the
    groups of the old and the new canonical student are looked at as well.
    """
    students = materialize(student_pairs(deltas["estudiantes"]))
    found = merge_groups(_of(staging, STUDENT_PAIRS, students), students, ["dni"], "id_estudiante")
    _add(staging, STUDENT_PAIRS, found.new_pairs)
    touched = students.select("dni").distinct()
    student_changes = _store_groups(staging, STUDENT_GROUPS, STUDENT_MAP, found.repeated, touched, "dni")
    student_map = staging.read(STUDENT_MAP)

    delta = materialize(enrollment_pairs(deltas["inscripciones"]))
    own = remap(delta.select("id_estudiante"), student_map, "id_estudiante")
    moved = [student_changes.select(F.col(c).alias("id_estudiante")) for c in (BEFORE, AFTER)]
    canonical = materialize(own.unionByName(moved[0]).unionByName(moved[1]).distinct())
    # Every staged student who stands for one of these: themselves and those who were merged into them.
    merged = keep_matching(student_map, canonical.withColumnRenamed("id_estudiante", KEPT_ID), [KEPT_ID])
    people = materialize(canonical.unionByName(merged.select(F.col(REPEATED_ID).alias("id_estudiante"))).distinct())
    known = materialize(keep_matching(_of(staging, ENROLLMENT_PAIRS, people), people, ["id_estudiante"]))
    new = materialize(delta.join(known, [*_PAIR, "id_inscripcion"], "left_anti"))
    _add(staging, ENROLLMENT_PAIRS, new)
    members = remap(known.unionByName(new), student_map, "id_estudiante").distinct()
    members = keep_matching(members, canonical, ["id_estudiante"])
    fresh = materialize(repeated_in_groups(members, _PAIR, "id_inscripcion"))
    enrollment_changes = _store_groups(staging, ENROLLMENT_GROUPS, ENROLLMENT_MAP, fresh, canonical, "id_estudiante")
    return Maps(student_map, staging.read(ENROLLMENT_MAP), student_changes, enrollment_changes, False)


def merged_until(staging: TableStore) -> int | None:
    """The staging version up to which the state holds every row."""
    return staging.read(MERGED).agg(F.max("version")).first()[0]


def refresh_maps(staging: TableStore, deltas: Mapping[str, DataFrame], since: int | None, seen: int) -> Maps:
    """Bring maps and state up to the version ``seen``; ``deltas`` are the rows published after ``since``."""
    held = merged_until(staging)
    tables = [u.staging_name(u.ENTITIES[e].source) for e in ("estudiantes", "inscripciones")]
    current = since is not None and held is not None and held >= since and all(staging.extends(t, held) for t in tables)
    maps = merge_deltas(staging, deltas) if current else rebuild_maps(staging)
    staging.replace(MERGED, staging.spark.createDataFrame([(seen,)], STATE_SCHEMAS[MERGED]))
    return maps
