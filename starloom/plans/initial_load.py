"""Full load: extracts to staging, staging to warehouse."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import attempts, dimensions, facts, keys, quality, watermark
from starloom.operators.cascade import Cascade, resolve_identities
from starloom.operators.dedupe import count_remapped
from starloom.plans import university as u
from starloom.plans.duplicate_maps import BUCKET_KEYS as STATE_KEYS
from starloom.plans.duplicate_maps import ENROLLMENT_MAP, MERGED, STATE_SCHEMAS, STUDENT_MAP
from starloom.session import STORE_SETTINGS, configure, materialize, scratch, settled, side_by_side
from starloom.sources.audit import AuditLog
from starloom.sources.staging import (
    BROKEN_LINE,
    ROW_ID,
    LineReport,
    academic_calendar,
    add_evaluation_date,
    line_report,
    number_in_file_order,
    read_csv,
    source_report,
    stage,
)
from starloom.sources.store import TableStore, bucket

# Facts are stored by the year of their date key; dimensions and the facts of students by the hash
# of the key that deltas look them up by as well.
FACT_PARTS = {table: "tiempoSKey div 10000" for table in u.FACT_KEYS}
# A bucket of a table should come to some gigabytes, so large warehouses want more of them.
BUCKETS = 8
BUCKET_KEYS = {
    "dim_estudiante": "idalumno",
    "dim_dictado": "idDictado",
    "fact_inscripcion": "alumnoSKey",
    "fact_examen_estudiante": "alumnoSKey",
}
NUMBERED = u.FACT_SURROGATES | {"dim_estudiante": "alumnoSKey", "dim_dictado": "dictadoSKey"}

ATTEMPT_COLUMNS = {
    "enrollment_id": "id_inscripcion",
    "group": ["id_estudiante", "id_dictado"],
    "date": "fecha",
    "tie": ["id_examen"],
    "passed": "aprobado",
}


class MissingSources(RuntimeError):
    """Some extracts are not there, so nothing was loaded."""


@dataclass(frozen=True)
class LoadReport:
    """What a full load did, as report tables."""

    version: int
    cleaning: DataFrame
    duplicates: DataFrame
    references: DataFrame
    tables: DataFrame


def open_staging(spark: SparkSession, root: str, buckets: int = BUCKETS) -> TableStore:
    """The staging tables and the state of their duplicate maps; ``buckets`` as for the warehouse."""
    by_key = {table: bucket(key, buckets) for table, key in STATE_KEYS.items()}
    numbered = {u.staging_name(source): ROW_ID for source in u.SOURCE_COLUMNS}
    return TableStore(configure(spark, **STORE_SETTINGS), root, u.STAGING_SCHEMAS | STATE_SCHEMAS, buckets=by_key, numbered=numbered)


def open_warehouse(spark: SparkSession, root: str, buckets: int = BUCKETS) -> TableStore:
    """The warehouse tables; ``buckets`` is part of how they are stored and has to stay the same."""
    by_key = {table: bucket(key, buckets) for table, key in BUCKET_KEYS.items()}
    return TableStore(configure(spark, **STORE_SETTINGS), root, u.WAREHOUSE_SCHEMAS, FACT_PARTS, by_key, NUMBERED)


def check_sources(spark: SparkSession, folder: str) -> DataFrame:
    files = {f"{source}.csv": u.staging_name(source) for source in u.SOURCE_COLUMNS}
    return source_report(spark, folder, files, list(u.STAGING_SCHEMAS))


def read_source(spark: SparkSession, folder: str, source: str, multi_line: bool = False) -> tuple[DataFrame, LineReport]:
    """One extract with ``row_id`` in file order, and the count of its lines."""
    columns = u.SOURCE_COLUMNS[source]
    rows = number_in_file_order(read_csv(spark, f"{folder}/{source}.csv", columns, multi_line))
    return rows.drop(BROKEN_LINE), line_report(rows, source, columns)


def load_staging(
    staging: TableStore, folder: str, loaded_at: dt.datetime, as_of: dt.date, multi_line: bool = False
) -> DataFrame:
    """Replace every staging table by its extract; one report row per table.

    All extracts are read before anything is published, so a bad one leaves the
    old staging in place. ``multi_line`` is for extracts with line breaks inside
    quotes. An extract without rows is reported and leaves its table as it is.
    """
    missing = check_sources(staging.spark, folder).where(~F.col("existe")).select("archivo").collect()
    if missing:
        raise MissingSources(", ".join(sorted(row.archivo for row in missing)))

    def read(source: str) -> tuple[DataFrame, LineReport]:
        return read_source(staging.spark, folder, source, multi_line)

    def load(source: str) -> tuple:
        rows, lines = extracts[source]
        table = u.staging_name(source)
        if not lines.rows:
            return table, 0, 0, False
        if source == "evaluacion_curso":
            calendar = academic_calendar(extracts["dictado"][0], "id_dictado", "periodo", "anio_academico", [ROW_ID])
            rows = add_evaluation_date(rows, calendar, "id_dictado", as_of.isoformat())
        staging.replace(table, stage(rows, f"{source}.csv", F.lit(loaded_at)))
        return table, lines.rows, lines.short, True

    with staging.transaction(), scratch(staging.spark):
        extracts = dict(zip(u.SOURCE_COLUMNS, side_by_side([partial(read, source) for source in u.SOURCE_COLUMNS])))
        report = side_by_side([partial(load, source) for source in u.SOURCE_COLUMNS])
    return staging.spark.createDataFrame(report, "tabla string, filas bigint, filas_cortas bigint, publicada boolean")


def table_sizes(store: TableStore, tables: list[str]) -> DataFrame:
    return quality.row_counts({t: store.read(t) for t in tables})


def preload_report(staging: TableStore, folder: str) -> DataFrame:
    """Before a load: whether each extract is there and how big, and the rows its staging table holds."""
    rows = table_sizes(staging, [u.staging_name(source) for source in u.SOURCE_COLUMNS])
    return check_sources(staging.spark, folder).join(F.broadcast(rows), "tabla")


def type_all(staging: TableStore) -> dict[str, DataFrame]:
    """Every staged row of every entity with typed columns, written down: staging is read and cleaned once."""

    def typed(entity: u.Entity) -> DataFrame:
        return materialize(entity.typed(staging.read(u.staging_name(entity.source))))

    frames = side_by_side([partial(typed, entity) for entity in u.ENTITIES.values()])
    return dict(zip(u.ENTITIES, frames))


def clean_all(typed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The valid rows of every entity, one per key."""
    steps = [lambda entity=entity, name=name: materialize(entity.pick(typed[name])) for name, entity in u.ENTITIES.items()]
    return dict(zip(u.ENTITIES, side_by_side(steps)))


def cleaning_report(typed: dict[str, DataFrame], clean: dict[str, DataFrame]) -> DataFrame:
    """Rows kept, rejected and repeated per entity, counted on the typed and the picked rows."""
    return reduce(DataFrame.unionByName, [entity.counted(typed[name], clean[name]) for name, entity in u.ENTITIES.items()])


def duplicate_report(clean: dict[str, DataFrame], merged: Cascade, exams: DataFrame) -> DataFrame:
    """Counters of the identity cascade, one per row."""

    def counter(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("valor")).select(F.lit(name).alias("contador"), "valor")

    moved = count_remapped(clean["inscripciones"], merged.person_map, "id_estudiante")
    moved_exams = count_remapped(clean["examenes"], merged.enrollment_map, "id_inscripcion")
    ruled = attempts.consolidation_counts(exams, merged.enrollments, merged.enrollment_map, **ATTEMPT_COLUMNS)
    return (
        counter("estudiantes_duplicados", merged.person_map)
        .union(counter("inscripciones_duplicadas", merged.enrollment_map))
        .union(moved.select(F.lit("inscripciones_remapeadas"), "remapped"))
        .union(moved_exams.select(F.lit("examenes_remapeados"), "remapped"))
        .union(ruled.unpivot([], ["afectados", "grupos", "eliminados"], "contador", "valor"))
    )


def reference_report(clean: dict[str, DataFrame]) -> DataFrame:
    """Rows that found no parent, per branch of the dimensions."""
    return u.student_references(clean["estudiantes"], clean["programas"]).unionByName(u.offering_references(clean["dictados"], clean))


def load_warehouse(
    staging: TableStore, warehouse: TableStore, audit: AuditLog, as_of: dt.date, began: dt.datetime
) -> LoadReport:
    """Rebuild every warehouse table from staging and publish them together.

    ``began`` becomes the watermark and the staging version it reads is logged, so
    rows staged while the load runs are left to the first incremental run. A failed
    load leaves nothing pending.
    """
    with scratch(staging.spark):
        try:
            return _load_warehouse(staging, warehouse, audit, as_of, began)
        except BaseException:
            staging.discard()
            warehouse.discard()
            raise


def _load_warehouse(
    staging: TableStore, warehouse: TableStore, audit: AuditLog, as_of: dt.date, began: dt.datetime
) -> LoadReport:
    staging.discard()
    warehouse.discard()
    seen = staging.version()
    typed = type_all(staging)
    clean = clean_all(typed)
    merged = resolve_identities(clean["estudiantes"], clean["inscripciones"], clean["examenes"], u.CASCADE)
    staging.replace(STUDENT_MAP, merged.person_map)
    staging.replace(ENROLLMENT_MAP, merged.enrollment_map)
    staging.replace(MERGED, staging.read(MERGED).limit(0))  # these maps are narrower than the state of deltas

    enrollments = materialize(merged.enrollments)
    raw_exams = u.judged_exams(merged.exams)
    exams = attempts.consolidate_attempts(
        raw_exams, enrollments, merged.enrollment_map, attempt="numero_intento", **ATTEMPT_COLUMNS
    )

    students = u.student_dimension(merged.people, clean["programas"], as_of)
    offerings = u.offering_dimension(clean["dictados"], clean, as_of)
    side_by_side(
        [
            lambda: warehouse.replace(
                "dim_estudiante", keys.assign_surrogate_keys(students, "alumnoSKey", ["dni", "idalumno"])
            ),
            lambda: warehouse.replace("dim_dictado", keys.assign_surrogate_keys(offerings, "dictadoSKey", [ROW_ID])),
        ]
    )

    student_keys = u.student_keys(warehouse.read("dim_estudiante"))
    offering_keys = u.offering_keys(warehouse.read("dim_dictado"))
    # Written down with their keys: the calendar, the fact and the report read them.
    owned_exams = materialize(u.keyed_exams(exams, enrollments, [student_keys, offering_keys]))
    calendar = dimensions.calendar_dimension(u.dates_of(enrollments, owned_exams, clean["evaluaciones"]))
    built = {
        "fact_inscripcion": u.enrollment_fact(enrollments, student_keys, offering_keys),
        "fact_examen_estudiante": u.exam_fact(owned_exams),
        "fact_evaluacion_dictado": u.evaluation_fact(clean["evaluaciones"], offering_keys),
    }

    def store(table: str) -> None:
        warehouse.replace(table, keys.assign_keys_in_place(built[table], u.FACT_SURROGATES[table]))

    side_by_side([lambda: warehouse.replace("dim_tiempo", calendar), *[partial(store, table) for table in built]])

    run = audit.start(began, None)
    staging.publish()
    version = warehouse.publish()
    audit.close(run, began, None, max(began, dt.datetime.now()), watermark.OK, 0, version=seen)

    reports = [
        cleaning_report(typed, clean),
        duplicate_report(clean, merged, raw_exams),
        reference_report(clean),
        table_report(warehouse, clean, merged, enrollments, owned_exams, student_keys, offering_keys),
    ]
    return LoadReport(version, *side_by_side([partial(settled, report) for report in reports]))


def table_report(
    warehouse: TableStore,
    clean: dict[str, DataFrame],
    merged: Cascade,
    enrollments: DataFrame,
    owned_exams: DataFrame,
    student_keys: facts.KeyLookup,
    offering_keys: facts.KeyLookup,
) -> DataFrame:
    """Rows offered, kept, rejected and repeated per warehouse table, and rows stored."""
    always = F.lit(True)
    both = ["alumnoSKey", "dictadoSKey"]
    resolved = facts.resolve_keys(enrollments, [student_keys, offering_keys])
    evaluated = facts.resolve_keys(clean["evaluaciones"], [offering_keys])
    accounts = [
        quality.row_accounting(warehouse.read("dim_tiempo"), "dim_tiempo", always, ["tiempoSKey"]),
        quality.row_accounting(merged.people, "dim_estudiante", always, ["id_estudiante"]),
        quality.row_accounting(clean["dictados"], "dim_dictado", always, ["id_dictado"]),
        quality.row_accounting(resolved, "fact_inscripcion", quality.all_present(both), both),
        quality.row_accounting(
            owned_exams, "fact_examen_estudiante", quality.all_present(both), [*both, "numero_intento"]
        ),
        quality.row_accounting(
            evaluated, "fact_evaluacion_dictado", quality.all_present(["dictadoSKey"]), ["id_evaluacion"]
        ),
    ]
    stored = table_sizes(warehouse, list(u.WAREHOUSE_SCHEMAS)).withColumnRenamed("filas", "final")
    return reduce(DataFrame.unionByName, accounts).join(F.broadcast(stored), "tabla")


def run_full_load(
    spark: SparkSession,
    sources: str,
    staging_root: str,
    warehouse_root: str,
    audit_path: str,
    as_of: dt.date | None = None,
    began: dt.datetime | None = None,
    multi_line: bool = False,
) -> LoadReport:
    """Extracts to warehouse in one call."""
    began = began or dt.datetime.now()
    as_of = as_of or began.date()
    staging, warehouse = open_staging(spark, staging_root), open_warehouse(spark, warehouse_root)
    load_staging(staging, sources, began, as_of, multi_line)
    return load_warehouse(staging, warehouse, AuditLog(spark, audit_path), as_of, began)
