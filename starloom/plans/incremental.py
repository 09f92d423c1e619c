"""Incremental load: staged rows after the watermark into the warehouse."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators import attempts, constraints, dimensions, facts, keys, merge, repoint, scd, snapshot, watermark
from starloom.operators.dedupe import drop_mapped, remap
from starloom.operators.groups import AFTER, BEFORE
from starloom.operators.joins import drop_matching, keep_matching
from starloom.plans import university as u
from starloom.plans.duplicate_maps import Maps, refresh_maps
from starloom.plans.initial_load import ATTEMPT_COLUMNS, BUCKET_KEYS
from starloom.session import materialize, scratch, side_by_side
from starloom.sources.audit import AuditLog
from starloom.sources.store import TableStore

OFFERING_LOOKUPS = ("cursos", "docentes", "departamentos", "facultades")
LOOKUPS = ("programas", *OFFERING_LOOKUPS)
# A part of a table with more folders than this is written anew as one.
MOST_FOLDERS = 32
# Broken rules that an error carries, and that its message shows.
MOST_VIOLATIONS, SHOWN_VIOLATIONS = 1_000, 10


@dataclass(frozen=True)
class IncrementalReport:
    """Counters of one run."""

    delta_rows: int
    new_dates: int = 0
    students: dict[str, int] | None = None
    offerings: dict[str, int] | None = None
    facts: dict[str, dict[str, int]] | None = None
    history: dict[str, int] | None = None
    references: dict[str, int] | None = None
    canonical: dict[str, int] | None = None
    deleted: dict[str, int] | None = None


# A dimension whose rows a snapshot may have lost: its entity, table and natural key.
DELETABLE = (("estudiantes", "dim_estudiante", "idalumno"), ("dictados", "dim_dictado", "idDictado"))


def staged(staging: TableStore, entity: str) -> DataFrame:
    return staging.read(u.staging_name(u.ENTITIES[entity].source))


def replaced_since(staging: TableStore, entity: str, version: int | None) -> bool:
    """Whether a staging table was replaced, not only added to, since a version."""
    return version is not None and not staging.extends(u.staging_name(u.ENTITIES[entity].source), version)


def snapshot_of(staging: TableStore, entity: str, version: int) -> DataFrame:
    """Keys of an entity with what happened to their rows since a version, by digests of the typed columns."""
    described = u.ENTITIES[entity]
    table = u.staging_name(described.source)
    before, after = described.typed(staging.read_at(table, version)), described.typed(staging.read(table))
    columns = [c for c in after.columns if c not in (described.key, "row_id")]
    return snapshot.snapshot_changes(before, after, [described.key], columns)


def read_deltas(
    staging: TableStore, last: dt.datetime | None, version: int | None, snapshots: bool = False
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The new rows of every table: folders of staging as they are, and what is chosen from them written down.

    New is what was published after the version that the last good run has seen.
    Logs without versions are read by their watermark, and without any good run
    everything is new. With ``snapshots`` a table that was replaced is compared with
    what the last run saw: of its rows only those of new and changed keys are new. The
    second result are these comparisons by entity.
    """
    compared: dict[str, DataFrame] = {}
    if snapshots:
        names = [name for name in u.ENTITIES if replaced_since(staging, name, version)]
        compared = {name: materialize(snapshot_of(staging, name, version)) for name in names}

    def read(name: str) -> DataFrame:
        entity = u.ENTITIES[name]
        rows = staging.read_since(u.staging_name(entity.source), version)
        if name in compared:
            changed = compared[name].where(F.col("cambio").isin(snapshot.INSERTED, snapshot.CHANGED))
            numbers = keep_matching(entity.typed(rows, [entity.key]), changed, [entity.key])
            rows = keep_matching(rows, numbers, ["row_id"])
        after = last if version is None else None
        return rows if after is None and name not in compared else materialize(watermark.delta(rows, after))

    return dict(zip(u.ENTITIES, side_by_side([partial(read, name) for name in u.ENTITIES]))), compared


def delta_sizes(deltas: dict[str, DataFrame]) -> dict[str, int]:
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("entity"), "rows")
        for name, df in deltas.items()
    ]
    return {row.entity: row.rows for row in reduce(DataFrame.union, counts).collect()}


def merge_dimension(
    warehouse: TableStore, table: str, delta: DataFrame, policy: scd.ScdPolicy, as_of: dt.date
) -> dict[str, int]:
    """Apply a delta to a dimension: the buckets of its keys are read, and those with a changed version written anew."""
    natural = policy.natural
    classified = materialize(scd.classify(warehouse.read_keys(table, delta), delta, policy))
    counts = scd.scd_counts(classified).first().asDict()
    if not counts["insertados"] and not counts["actualizados_scd1"]:
        return counts
    rows = classified.where(F.col("_action").isin(scd.INSERT, scd.NEW_VERSION))
    # New versions are numbered before stored ones are closed, and stored in files of their own.
    added = scd.added_versions(warehouse.read_parts(table, []), rows, policy, ["row_id"], warehouse.next_number(table))
    if counts["actualizados_scd2"] or counts["actualizados_scd1"]:
        changed = classified.where(F.col("_action").isin(scd.NEW_VERSION, scd.UPDATE)).select(natural)
        parts = warehouse.parts_of(table, changed)
        revised = scd.revise_versions(warehouse.read_parts(table, parts), classified, policy, as_of)
        warehouse.replace_parts(table, revised, parts)
    warehouse.append(table, added)
    return counts


def merge_fact(
    warehouse: TableStore, table: str, rows: DataFrame, update: list[str]
) -> dict[str, int]:
    """Upsert into a fact. Only the parts that hold an updated row are rewritten, and only buckets of its keys read."""
    rows = materialize(rows)
    unique, surrogate = u.FACT_KEYS[table], u.FACT_SURROGATES[table]
    start = warehouse.next_number(table)
    updated = 0
    if unique:
        stored = warehouse.read_keys(table, rows)
        hits = materialize(keep_matching(stored.select(*unique, "tiempoSKey"), rows, unique))
        updated = hits.count()
        fresh = drop_matching(rows, hits, unique)
        if updated:
            parts = warehouse.parts_of(table, hits)
            touched = merge.updated_rows(warehouse.read_parts(table, parts), rows, unique, update)
            warehouse.replace_parts(table, touched, parts)
    else:
        fresh = rows
    numbered = keys.assign_keys_in_place(fresh, surrogate, start)  # written down by the numbering
    inserted = numbered.count()
    if inserted:
        warehouse.append(table, numbered)
    return {"insertados": inserted, "actualizados": updated}


def narrowed(lookup: facts.KeyLookup, rows: DataFrame) -> facts.KeyLookup:
    """A key lookup cut down to the natural keys that ``rows`` asks for."""
    asked = rows.select(F.col(lookup.fact_column).alias(lookup.natural))
    small = materialize(keep_matching(lookup.key_map, asked, [lookup.natural]))
    return facts.KeyLookup(lookup.fact_column, small, lookup.natural, lookup.surrogate)


def students_of(warehouse: TableStore, rows: DataFrame) -> facts.KeyLookup:
    """Keys of the students that ``rows`` asks for, from their buckets of the dimension."""
    asked = rows.select(F.col("id_estudiante").alias("idalumno"))
    return narrowed(u.student_keys(warehouse.read_keys("dim_estudiante", asked)), rows)


def offerings_of(warehouse: TableStore, rows: DataFrame) -> facts.KeyLookup:
    """Keys of the offerings that ``rows`` asks for, from their buckets of the dimension."""
    asked = rows.select(F.col("id_dictado").alias("idDictado"))
    return narrowed(u.offering_keys(warehouse.read_keys("dim_dictado", asked)), rows)


def absorbed_students(warehouse: TableStore, maps: Maps, as_of: dt.date, move: bool) -> dict[str, int]:
    """Loaded students who now stand for another one, since a smaller id of the same person came later.

    Counted always. With ``move`` their facts get the key of the canonical student, where no row
    of that student has the unique key already, and their versions are closed.
    """
    found = {"cambiados": 0, "cargados": 0, "movidas": 0, "retenidas": 0}
    changes = maps.student_changes.where(F.col(AFTER) < F.col(BEFORE))
    found["cambiados"] = changes.count()
    if not found["cambiados"]:
        return found
    chased = repoint.follow_chains(changes, maps.students)
    asked = chased.select(F.col("id").alias("idalumno")).union(chased.select(AFTER))
    dimension = warehouse.read_keys("dim_estudiante", asked)
    changed = materialize(repoint.key_changes(dimension, chased, "idalumno", "alumnoSKey"))
    found["cargados"] = changed.select("id").distinct().count()
    if not move or not found["cargados"]:
        return found
    both = changed.select(F.col("clave").alias("alumnoSKey")).union(changed.select("clave_nueva")).dropna()
    for table in ("fact_inscripcion", "fact_examen_estudiante"):
        result = repoint.repoint(
            warehouse.read_keys(table, both), changed, "alumnoSKey", u.FACT_KEYS[table], u.FACT_SURROGATES[table]
        )
        count = result.moved.count()
        found["movidas"] += count
        found["retenidas"] += result.blocked.count()
        if count:
            surrogate = u.FACT_SURROGATES[table]
            old = keep_matching(warehouse.read_keys(table, both), result.moved, [surrogate])
            parts = warehouse.parts_of(table, old)
            stay = warehouse.read_parts(table, parts).join(result.moved.select(surrogate), surrogate, "left_anti")
            warehouse.replace_parts(table, stay, parts)
            warehouse.append(table, result.moved)
    gone = changed.where("clave_nueva is not null").select(F.col("id").alias("idalumno")).distinct()
    close_keys(warehouse, "dim_estudiante", gone, "idalumno", as_of)
    return found


def close_keys(warehouse: TableStore, table: str, ids: DataFrame, natural: str, as_of: dt.date) -> int:
    """Close the current versions of some natural keys; how many there were."""
    stored = warehouse.read_keys(table, ids)
    open_ = materialize(keep_matching(stored.where("es_actual").select(natural), ids, [natural]))
    count = open_.count()
    if count:
        parts = warehouse.parts_of(table, open_)
        warehouse.replace_parts(table, repoint.close_versions(warehouse.read_parts(table, parts), open_, natural, as_of), parts)
    return count


def close_deleted(warehouse: TableStore, compared: dict[str, DataFrame], as_of: dt.date) -> dict[str, int]:
    """Close the versions of rows that a replaced staging table no longer has."""
    closed = {}
    for entity, table, natural in DELETABLE:
        if entity in compared:
            gone = compared[entity].where(F.col("cambio") == snapshot.DELETED)
            ids = materialize(gone.select(F.col(u.ENTITIES[entity].key).alias(natural)))
            closed[entity] = close_keys(warehouse, table, ids, natural, as_of)
    return closed


def enrollments_of(
    staging: TableStore, exams: DataFrame, student_map: DataFrame
) -> DataFrame:
    """Clean enrollments of the given exams from all of staging, with canonical students.

    Only the columns that decide whether an enrollment is valid are cleaned, the ids among them.
    """
    entity = u.ENTITIES["inscripciones"]
    rows = keep_matching(entity.typed(staged(staging, "inscripciones"), entity.judged()), exams, ["id_inscripcion"])
    return materialize(remap(entity.pick(rows), student_map, "id_estudiante"))


@dataclass(frozen=True)
class Options:
    """What a run does beyond the plain rules."""

    max_attempts: int | None = None
    # Compare replaced staging tables with what the last run saw, and close the versions of deleted rows.
    snapshots: bool = False
    # Give the facts of students who now stand for another one that one's key.
    move_absorbed: bool = False


def apply_deltas(
    staging: TableStore,
    warehouse: TableStore,
    deltas: dict[str, DataFrame],
    sizes: dict[str, int],
    as_of: dt.date,
    options: Options,
    maps: Maps,
    compared: dict[str, DataFrame],
) -> IncrementalReport:
    """Clean the deltas and write the next state of the warehouse tables they touch."""
    clean = {name: u.ENTITIES[name].clean(deltas[name]) for name in u.ENTITIES if name not in LOOKUPS}
    student_map, enrollment_map = maps.students, maps.enrollments

    canonical = remap(clean["inscripciones"], student_map, "id_estudiante")
    cleaned = (
        drop_mapped(clean["estudiantes"], student_map, "id_estudiante"),
        drop_mapped(canonical, enrollment_map, "id_inscripcion"),
        u.judged_exams(remap(clean["examenes"], enrollment_map, "id_inscripcion")),
        clean["dictados"],
        clean["evaluaciones"],
    )
    students, enrollments, exams, offerings, evaluations = side_by_side([partial(materialize, df) for df in cleaned])

    calendar = materialize(dimensions.calendar_dimension(u.dates_of(enrollments, exams, evaluations)))
    new_dates = materialize(merge.new_rows(warehouse.read("dim_tiempo"), calendar, ["tiempoSKey"]))
    date_count = new_dates.count()
    if date_count:
        warehouse.append("dim_tiempo", new_dates)

    def lookups(*names: str) -> dict[str, DataFrame]:
        frames = [u.ENTITIES[name].clean(staged(staging, name)) for name in names]
        return dict(zip(names, side_by_side([partial(materialize, df) for df in frames])))

    def merge_students() -> tuple[dict[str, int], dict[str, int]]:
        if not sizes["estudiantes"]:
            return dict(scd.NO_CHANGES), {}
        parents = lookups("programas")
        delta = u.student_dimension(students, parents["programas"], as_of)
        counts = merge_dimension(warehouse, "dim_estudiante", delta, u.STUDENT_POLICY, as_of)
        return counts, counted(u.student_references(students, parents["programas"]))

    def merge_offerings() -> tuple[dict[str, int], dict[str, int]]:
        if not sizes["dictados"]:
            return dict(scd.NO_CHANGES), {}
        parents = lookups(*OFFERING_LOOKUPS)
        delta = u.offering_dimension(offerings, parents, as_of)
        counts = merge_dimension(warehouse, "dim_dictado", delta, u.OFFERING_POLICY, as_of)
        return counts, counted(u.offering_references(offerings, parents))

    (student_counts, no_parent), (offering_counts, no_parents) = side_by_side([merge_students, merge_offerings])
    unknown = no_parent | no_parents
    absorbed = absorbed_students(warehouse, maps, as_of, options.move_absorbed)
    deleted = close_deleted(warehouse, compared, as_of)

    fact_counts = {table: {"insertados": 0, "actualizados": 0} for table in u.FACT_KEYS}
    history = {"aceptados": 0, "rechazados": 0}

    def merge_enrollments() -> None:
        fact = u.enrollment_fact(enrollments, students_of(warehouse, enrollments), offerings_of(warehouse, enrollments))
        fact_counts["fact_inscripcion"] = merge_fact(warehouse, "fact_inscripcion", fact, ["estado", "abandono"])

    def merge_exams() -> None:
        accepted, turned = new_exams(staging, warehouse, exams, student_map, enrollment_map, options.max_attempts)
        history.update(turned)
        fact_counts["fact_examen_estudiante"] = merge_fact(
            warehouse, "fact_examen_estudiante", u.exam_fact(accepted), ["nota", "aprobado"]
        )

    def merge_evaluations() -> None:
        fact = u.evaluation_fact(evaluations, offerings_of(warehouse, evaluations))
        fact_counts["fact_evaluacion_dictado"] = merge_fact(warehouse, "fact_evaluacion_dictado", fact, [])

    merges = {"inscripciones": merge_enrollments, "examenes": merge_exams, "evaluaciones": merge_evaluations}
    side_by_side([step for entity, step in merges.items() if sizes[entity]])
    return IncrementalReport(
        sum(sizes.values()), date_count, student_counts, offering_counts, fact_counts, history, unknown, absorbed, deleted
    )


def counted(references: DataFrame) -> dict[str, int]:
    return {row.branch: row.missing_rows for row in references.collect()}


def new_exams(
    staging: TableStore,
    warehouse: TableStore,
    exams: DataFrame,
    student_map: DataFrame,
    enrollment_map: DataFrame,
    max_attempts: int | None,
) -> tuple[DataFrame, dict[str, int]]:
    """The exams that the attempt rules accept, given the stored history of their students, and how many they do not."""
    owners = enrollments_of(staging, exams, student_map)
    consolidated = attempts.consolidate_attempts(
        exams, owners, enrollment_map, attempt="numero_intento", **ATTEMPT_COLUMNS
    )
    lookups = [students_of(warehouse, owners), offerings_of(warehouse, owners)]
    both = ["alumnoSKey", "dictadoSKey"]
    resolved = materialize(u.keyed_exams(consolidated, owners, lookups))
    known = resolved.dropna(subset=both)
    accepted = materialize(
        attempts.filter_by_history(
            resolved,
            warehouse.read_keys("fact_examen_estudiante", known),
            keys=both,
            date="fecha",
            tie=["id_examen"],
            passed="aprobado",
            attempt="numero_intento",
            max_attempts=max_attempts,
        )
    )
    return accepted, attempts.history_counts(known, accepted).first().asDict()


class BrokenRules(RuntimeError):
    """What a run has written breaks rules of the warehouse, so nothing of it is published."""

    def __init__(self, rows: list):
        self.rows = rows
        shown = "; ".join(f"{r.tabla} {r.regla}: {r.clave} ({r.filas})" for r in rows[:SHOWN_VIOLATIONS])
        super().__init__(f"{shown}{' ...' if len(rows) > SHOWN_VIOLATIONS else ''}")


def violations(warehouse: TableStore) -> DataFrame:
    """Rules that the rows written and not yet published break."""

    def read(table: str, keys: DataFrame) -> DataFrame:
        by_bucket = BUCKET_KEYS.get(table) in keys.columns
        return warehouse.read_keys(table, keys) if by_bucket else warehouse.read(table)

    empty = warehouse.spark.createDataFrame([], constraints.VIOLATIONS)
    return constraints.violations(u.CONSTRAINTS, warehouse.pending_rows(), read, empty)


def check_rules(warehouse: TableStore) -> None:
    """Stop before publishing if a rule is broken; the error lists the offending keys, up to a number."""
    rows = violations(warehouse).orderBy("tabla", "regla", "clave").limit(MOST_VIOLATIONS).collect()
    if rows:
        raise BrokenRules(rows)


def run_incremental(
    staging: TableStore,
    warehouse: TableStore,
    audit: AuditLog,
    began: dt.datetime | None = None,
    as_of: dt.date | None = None,
    max_attempts: int | None = None,
    snapshots: bool = False,
    move_absorbed: bool = False,
) -> IncrementalReport:
    """Load everything staged since the last good run.

    All tables are published together at the end, the duplicate maps of staging just
    before the warehouse, if the new rows keep the rules of the warehouse. A failed run
    publishes nothing, is logged with its error, and leaves the watermark and the version where they were. See ``Options`` for
    ``snapshots`` and ``move_absorbed``.
    """
    began = began or dt.datetime.now()
    as_of = as_of or began.date()
    options = Options(max_attempts, snapshots, move_absorbed)
    last, version = audit.last_watermark(), audit.last_version()
    run = audit.start(began, last)
    try:
        with warehouse.transaction(), staging.transaction(), scratch(staging.spark):
            seen = staging.version()
            deltas, compared = read_deltas(staging, last, version, snapshots)
            sizes = delta_sizes(deltas)
            total = sum(sizes.values())
            report = IncrementalReport(0)
            if total or compared:
                maps = refresh_maps(staging, deltas, version, seen)
                report = apply_deltas(staging, warehouse, deltas, sizes, as_of, options, maps, compared)
                check_rules(warehouse)
                for store in (warehouse, staging):
                    for table in {**store.parts, **store.buckets}:
                        store.compact(table, MOST_FOLDERS)
    except Exception as error:
        audit.close(run, began, last, max(began, dt.datetime.now()), watermark.ERROR, 0, str(error))
        raise
    audit.close(run, began, last, max(began, dt.datetime.now()), watermark.OK, total, version=seen)
    return report
