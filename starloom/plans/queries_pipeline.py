"""Queries over a whole load: extracts, full load, a delivery that lands later, incremental load.

The given tables are rendered as extracts (see ``queries_university``) and written as CSV files.
Orders, line items and events before a date or of a kind are in the first extracts, the others
land later together with changed and new students and changed offerings. A load is made once per
session and folder of tables; each query reads one of its results. Facts are shown with natural
keys, since the surrogate ones follow no order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans import queries_university as q
from starloom.plans import university as u
from starloom.plans.incremental import IncrementalReport
from starloom.plans.initial_load import LoadReport, load_staging, load_warehouse, open_staging, open_warehouse, preload_report
from starloom.plans.queries_university import (
    COURSES_SQL,
    DEPARTMENTS_SQL,
    DIM_OFFERING_SQL,
    DIM_STUDENT_SQL,
    ENROLLMENTS_SQL,
    EXAMS_SQL,
    FACULTIES_SQL,
    OFFERINGS_SQL,
    PROGRAMMES_SQL,
    STUDENTS_SQL,
    TEACHERS_SQL,
)
from starloom.plans.registry import REGISTRY, Tables
from starloom.session import new_folder, settled, side_by_side
from starloom.sources.audit import AuditLog
from starloom.sources.store import TableStore
from starloom.streaming.landing import run_cycle

query = REGISTRY.query

FIRST, LATER = dt.datetime(2025, 1, 1, 8), dt.datetime(2026, 1, 2, 8)
CUT = dt.date(1997, 7, 1)
LATE_EVENT = "click"
MOVED_SEGMENT, NEW_SEGMENT = "BUILDING", "MACHINERY"
# Parts of a large size get another room, small ones another shift.
BIG, SMALL = 40, 5
NEW_STUDENT = 10_000_000


# The row numbers of rendered rows follow these columns of their tables.
ROW_ORDER: dict[str, Callable[[], Column]] = {
    "region": lambda: F.col("r_regionkey"), "nation": lambda: F.col("n_nationkey"), "part": lambda: F.col("p_partkey"),
    "supplier": lambda: F.col("s_suppkey"), "customer": lambda: F.col("c_custkey"), "orders": lambda: F.col("o_orderkey"),
    "lineitem": q.exam_order, "events": lambda: F.col("event_id"),
}


@dataclass(frozen=True)
class Period(Tables):
    """The tables with the rows of one side of the cut, in the order of the row numbers they are rendered with.

    Rendering keeps the order, as second copies come behind all first ones. So the columns of the
    tables are sampled, moved and sorted, and the text is made once, where it is written.
    """

    late: bool = False

    def __getattr__(self, name: str) -> DataFrame:
        df = super().__getattr__(name)
        late = {
            "orders": F.col("o_orderdate") >= F.lit(CUT) if name == "orders" else None,
            "lineitem": F.col("l_shipdate") >= F.lit(CUT) if name == "lineitem" else None,
            "events": F.col("event_type") == LATE_EVENT if name == "events" else None,
        }.get(name)
        rows = df if late is None else df.where(late if self.late else ~late)
        order = ROW_ORDER.get(name)
        return rows.repartitionByRange(order()).sortWithinPartitions(order()) if order else rows


def programme_links(t: Tables) -> DataFrame:
    return q.raw(t.part, F.col("p_partkey"), id_curso=F.col("p_partkey"), id_programa=F.col("p_partkey") % 25)


RENDERED = {
    "facultad": q.faculties, "departamento": q.departments, "programa": q.programmes, "curso": q.courses, "docente": q.teachers,
    "estudiante": q.students, "dictado": q.offerings, "inscripcion": q.enrollments, "examen": q.exams,
    "evaluacion_curso": q.evaluations, "curso_programa": programme_links,
}


def changed_students(t: Tables) -> DataFrame:
    """Students of one market segment change their programme; each of another has a new fellow student."""
    first = q.students(t).where(F.col("row_id") < q.SECOND)
    segment = F.upper("nombre_raw")
    moved = first.where(segment == MOVED_SEGMENT).withColumn(
        "id_programa_raw", ((F.col("id_programa_raw").cast("int") + 1) % 25).cast("string")
    )
    key = F.col("row_id")
    new = first.where(segment == NEW_SEGMENT).withColumns(
        {
            "id_estudiante_raw": (key + NEW_STUDENT).cast("string"),
            "dni_raw": F.when(F.col("dni_raw") == "12.345", F.col("dni_raw")).otherwise((key + 30_000_000).cast("string")),
            "row_id": key + q.SECOND,
        }
    )
    return moved.unionByName(new)


def changed_offerings(t: Tables) -> DataFrame:
    size = F.col("cupo_maximo_raw").cast("int") + 10
    rows = q.offerings(t).where(F.col("row_id") < q.SECOND).where((size > BIG) | (size < SMALL))
    return rows.withColumns(
        {
            "aula_raw": F.when(size > BIG, F.lit("lab-z")).otherwise(F.col("aula_raw")),
            "turno_raw": F.when(size < SMALL, F.lit("NOCHE")).otherwise(F.col("turno_raw")),
        }
    )


LATER_RENDERED = {
    "estudiante": changed_students, "dictado": changed_offerings, "inscripcion": q.enrollments, "examen": q.exams,
    "evaluacion_curso": q.evaluations,
}


# A compressed file is read by one task; a sorted partition, of which adaptive execution sets the size, makes one file.
EXTRACT_COMPRESSION = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def write_extract(df: DataFrame, source: str, path: str) -> None:
    """Staging text, in the order of its row numbers (see ``Period``), as a comma CSV, compressed the quick way."""
    columns = [F.col(f"{c}_raw").alias(c) if f"{c}_raw" in df.columns else F.lit(None).cast("string").alias(c) for c in u.SOURCE_COLUMNS[source]]
    out = df.select(*columns).write.options(**EXTRACT_COMPRESSION)
    out.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@dataclass(frozen=True)
class Loaded:
    """A finished load: its stores, its log and its reports."""

    sources: str
    staging: TableStore
    warehouse: TableStore
    audit: AuditLog
    staged: DataFrame
    full: LoadReport
    later: IncrementalReport
    before: DataFrame


_LOADED: dict[tuple[str, str], Loaded] = {}


def loaded(t: Tables) -> Loaded:
    """The load over a folder of tables, made when it is first asked for."""
    name = (t.spark.sparkContext.applicationId, t.folder)
    if name not in _LOADED:
        _LOADED[name] = run_load(t)
    return _LOADED[name]


def run_load(t: Tables) -> Loaded:
    spark, root = t.spark, new_folder(t.spark)
    first, late = Period(spark, t.folder), Period(spark, t.folder, True)
    side_by_side([partial(write_extract, make(first), source, f"{root}/fuentes/{source}.csv") for source, make in RENDERED.items()])
    staging, warehouse = open_staging(spark, f"{root}/staging"), open_warehouse(spark, f"{root}/dwh")
    audit = AuditLog(spark, f"{root}/auditoria")
    staged = load_staging(staging, f"{root}/fuentes", FIRST, FIRST.date())
    before = settled(preload_report(staging, f"{root}/fuentes"))
    full = load_warehouse(staging, warehouse, audit, FIRST.date(), FIRST)
    side_by_side([partial(write_extract, make(late), source, f"{root}/llegadas/{source}") for source, make in LATER_RENDERED.items()])
    later = run_cycle(
        staging, warehouse, audit, f"{root}/llegadas", f"{root}/marcas", list(LATER_RENDERED), lambda: LATER, began=LATER, as_of=LATER.date()
    )
    for store in (staging, warehouse):
        store.discard()
    return Loaded(f"{root}/fuentes", staging, warehouse, audit, staged, full, later, before)


def dated(sql: str, table: str, column: str, late: bool) -> str:
    """A rendered table's SQL over one side of the cut."""
    side = f"{column} >= DATE '{CUT}'" if late else f"{column} < DATE '{CUT}'"
    return sql.replace(f"FROM {table} WHERE", f"FROM {table} WHERE {side} AND")


RAW_ROWS = {
    "facultad": "2 * (SELECT count(*) FROM region)",
    "departamento": "2 * (SELECT count(*) FROM nation)",
    "programa": "2 * (SELECT count(*) FROM nation)",
    "curso": "2 * (SELECT count(*) FROM part)",
    "docente": "2 * (SELECT count(*) FROM supplier)",
    "estudiante": "2 * (SELECT count(*) FROM customer)",
    "dictado": "2 * (SELECT count(*) FROM part)",
    "inscripcion": f"(SELECT count(*) FROM orders WHERE o_orderdate < DATE '{CUT}')",
    "examen": f"(SELECT count(*) FROM lineitem WHERE l_shipdate < DATE '{CUT}')",
    "evaluacion_curso": f"(SELECT count(*) FROM events WHERE event_type <> '{LATE_EVENT}')",
    "curso_programa": "(SELECT count(*) FROM part)",
}
LATER_ROWS = {
    "estudiante": f"(SELECT count(*) FROM customer WHERE c_mktsegment IN ('{MOVED_SEGMENT}', '{NEW_SEGMENT}'))",
    "dictado": f"(SELECT count(*) FROM part WHERE p_size > {BIG} OR p_size < {SMALL})",
    "inscripcion": f"(SELECT count(*) FROM orders WHERE o_orderdate >= DATE '{CUT}')",
    "examen": f"(SELECT count(*) FROM lineitem WHERE l_shipdate >= DATE '{CUT}')",
    "evaluacion_curso": f"(SELECT count(*) FROM events WHERE event_type = '{LATE_EVENT}')",
}


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query("load_staging_report", union([f"SELECT 'stg_{s}' AS tabla, {n} AS filas, 0 AS filas_cortas, TRUE AS publicada" for s, n in RAW_ROWS.items()]))
def load_staging_report(t: Tables) -> DataFrame:
    return loaded(t).staged


@query("load_source_diagnostic", union([f"SELECT '{s}.csv' AS archivo, 'stg_{s}' AS tabla, TRUE AS existe, TRUE AS tabla_existe, {n} AS filas" for s, n in RAW_ROWS.items()]))
def load_source_diagnostic(t: Tables) -> DataFrame:
    return loaded(t).before.drop("bytes")


def _staged_rows(source: str) -> str:
    later = LATER_ROWS.get(source, "0")
    origin = f"'{source}.csv'"
    return f"SELECT 'stg_{source}' AS tabla, {RAW_ROWS[source]} + {later} AS filas, {RAW_ROWS[source]} + {later} AS ultima, 1 AS primera, {origin} AS archivo"


@query("load_staged_rows", union([_staged_rows(s) for s in RAW_ROWS]))
def load_staged_rows(t: Tables) -> DataFrame:
    """Staging after both deliveries: rows are numbered from 1 without a gap, the later ones behind."""
    staging = loaded(t).staging
    return reduce(DataFrame.unionByName, [numbered_rows(staging.read(u.staging_name(s)), u.staging_name(s)) for s in RAW_ROWS])


def numbered_rows(staged: DataFrame, table: str) -> DataFrame:
    """One row: how many different row numbers there are, the last, the first, and the file.

    Numbers are marked in bitmaps of 32,768 neighbours each, an exact count for which no number
    moves: files hold runs of numbers, so a task has few bitmaps.
    """
    marked = marks_of(staged, "row_id", F.max("archivo_origen").alias("archivo"))
    return marked.agg(
        different().alias("filas"), F.max("ultima").alias("ultima"),
        F.min("primera").alias("primera"), F.max("archivo").alias("archivo"),
    ).select(F.lit(table).alias("tabla"), "*")


def marks_of(df: DataFrame, column: str, *more: Column) -> DataFrame:
    """The numbers of a column as bitmaps, with the rows, the numbers, the last and the first of each bitmap."""
    number = F.col(column)
    return df.groupBy(F.bitmap_bucket_number(number).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_marks"),
        F.count(F.lit(1)).alias("_rows"), F.count(number).alias("_numbers"),
        F.max(number).alias("ultima"), F.min(number).alias("primera"), *more,
    )


def different() -> Column:
    """How many different numbers there are in bitmaps."""
    return F.coalesce(F.sum(F.bitmap_count("_marks")), F.lit(0))


def checked_keys(numbered: DataFrame, key: str, table: str) -> DataFrame:
    """One row: the first key, whether the last is the number of keys, and whether no row repeats one or has none."""
    rows, held = (F.coalesce(F.sum(c), F.lit(0)) for c in ("_rows", "_numbers"))
    return marks_of(numbered, key).agg(
        F.min("primera").alias("primera"), (F.max("ultima") == held).alias("densa"), (different() == rows).alias("unica")
    ).select(F.lit(table).alias("tabla"), "*")


@query(
    "load_staging_order",
    f"""
    SELECT o_orderkey AS id_inscripcion, CASE WHEN o_orderdate < DATE '{CUT}' THEN DATE '{FIRST.date()}' ELSE DATE '{LATER.date()}' END AS fecha_carga,
           (CASE WHEN o_orderdate < DATE '{CUT}' THEN 0 ELSE {RAW_ROWS["inscripcion"]} END)
           + row_number() OVER (PARTITION BY o_orderdate < DATE '{CUT}' ORDER BY o_orderkey) AS row_id
    FROM orders
    """,
)
def load_staging_order(t: Tables) -> DataFrame:
    """Staged enrollments are numbered in the order of their files."""
    rows = loaded(t).staging.read("stg_inscripcion")
    return rows.select(F.col("id_inscripcion_raw").cast("bigint").alias("id_inscripcion"), F.to_date("fecha_carga").alias("fecha_carga"), "row_id")


FIRST_EXAMS_SQL, LATER_EXAMS_SQL = (dated(EXAMS_SQL, "lineitem", "l_shipdate", late) for late in (False, True))
FIRST_ENROLLMENTS_SQL, LATER_ENROLLMENTS_SQL = (dated(ENROLLMENTS_SQL, "orders", "o_orderdate", late) for late in (False, True))

# Rows that pass the rules of an entity, before repeated keys go.
VALID_ROWS = {
    "facultad": (RAW_ROWS["facultad"], FACULTIES_SQL),
    "departamento": ("2 * (SELECT count(*) FROM nation WHERE n_nationkey % 7 <> 6)", DEPARTMENTS_SQL),
    "programa": (RAW_ROWS["programa"], PROGRAMMES_SQL),
    "curso": ("2 * (SELECT count(*) FROM part WHERE p_partkey % 11 <> 3)", COURSES_SQL),
    "docente": ("2 * (SELECT count(*) FROM supplier WHERE s_acctbal >= 0)", TEACHERS_SQL),
    "estudiante": ("(SELECT count(*) FROM customer WHERE c_custkey % 10 <> 0)", STUDENTS_SQL),
    "dictado": ("2 * (SELECT count(*) FROM part WHERE p_partkey % 13 <> 5)", OFFERINGS_SQL),
    "inscripcion": (f"(SELECT count(*) FROM ({FIRST_ENROLLMENTS_SQL}))", FIRST_ENROLLMENTS_SQL),
    "examen": (f"(SELECT count(*) FROM lineitem WHERE l_quantity / 4 <= 10 AND l_linenumber > 1 AND l_shipdate < DATE '{CUT}')", FIRST_EXAMS_SQL),
    "evaluacion_curso": (
        f"(SELECT count(*) FROM events WHERE event_type <> '{LATE_EVENT}' AND user_id IS NOT NULL)",
        f"SELECT event_id FROM events WHERE event_type <> '{LATE_EVENT}' AND user_id IS NOT NULL",
    ),
}


@query(
    "load_cleaning_report",
    union(
        [
            f"SELECT 'stg_{s}' AS tabla, {RAW_ROWS[s]} AS total, (SELECT count(*) FROM ({kept})) AS validos, "
            f"{RAW_ROWS[s]} - {valid} AS rechazados, {valid} - (SELECT count(*) FROM ({kept})) AS duplicados"
            for s, (valid, kept) in VALID_ROWS.items()
        ]
    ),
)
def load_cleaning_report(t: Tables) -> DataFrame:
    return loaded(t).full.cleaning


@query(
    "load_reference_report",
    f"""
    WITH o AS (SELECT * FROM ({DIM_OFFERING_SQL}))
    SELECT 'programa' AS branch, count(*) FILTER (WHERE "nombrePrograma" IS NULL) AS missing_rows FROM ({DIM_STUDENT_SQL})
    UNION ALL SELECT 'curso', count(*) FILTER (WHERE "nombreCurso" IS NULL) FROM o
    UNION ALL SELECT 'docente', count(*) FILTER (WHERE "nombreDocente" IS NULL) FROM o
    UNION ALL SELECT 'departamento', count(*) FILTER (WHERE "nombreDep" IS NULL) FROM o
    UNION ALL SELECT 'facultad', count(*) FILTER (WHERE "nombreFac" IS NULL) FROM o
    """,
)
def load_reference_report(t: Tables) -> DataFrame:
    return loaded(t).full.references


@query(
    "load_dim_estudiante",
    f"""
    WITH b AS ({DIM_STUDENT_SQL}), p AS ({PROGRAMMES_SQL}),
    m AS (SELECT c_custkey AS idalumno, nombre_programa FROM customer JOIN p ON id_programa = (c_nationkey + 1) % 25 WHERE c_mktsegment = '{MOVED_SEGMENT}'),
    n AS (SELECT c_custkey AS idalumno FROM customer WHERE c_mktsegment = '{NEW_SEGMENT}')
    SELECT idalumno, dni, nombre, genero, "edadIngreso", "nombrePrograma", DATE '{FIRST.date()}' AS valid_from,
           CASE WHEN m.idalumno IS NOT NULL THEN DATE '{LATER.date()}' END AS valid_to, m.idalumno IS NULL AS es_actual
    FROM b LEFT JOIN m USING (idalumno)
    UNION ALL SELECT idalumno, dni, nombre, genero, "edadIngreso", m.nombre_programa, DATE '{LATER.date()}', NULL, TRUE FROM b JOIN m USING (idalumno)
    UNION ALL SELECT idalumno + {NEW_STUDENT}, idalumno + 30000000, nombre, genero, "edadIngreso", "nombrePrograma", DATE '{LATER.date()}', NULL, TRUE
    FROM b SEMI JOIN n USING (idalumno)
    """,
)
def load_dim_estudiante(t: Tables) -> DataFrame:
    columns = ["idalumno", "dni", "nombre", "genero", "edadIngreso", "nombrePrograma", "valid_from", "valid_to", "es_actual"]
    return loaded(t).warehouse.read("dim_estudiante").select(columns)


@query(
    "load_dim_dictado",
    f"""
    WITH b AS ({DIM_OFFERING_SQL}), d AS (SELECT b.*, p_size FROM b JOIN part ON p_partkey = "idDictado"),
    r AS (SELECT *, CASE WHEN p_size > {BIG} THEN 'Lab-Z' ELSE aula END AS room FROM d)
    SELECT "idDictado", turno, room AS aula, "cupoMax", "nombreDocente", DATE '{FIRST.date()}' AS valid_from,
           CASE WHEN p_size < {SMALL} THEN DATE '{LATER.date()}' END AS valid_to, p_size >= {SMALL} AS es_actual FROM r
    UNION ALL SELECT "idDictado", 'Noche', room, "cupoMax", "nombreDocente", DATE '{LATER.date()}', NULL, TRUE FROM r WHERE p_size < {SMALL}
    """,
)
def load_dim_dictado(t: Tables) -> DataFrame:
    columns = ["idDictado", "turno", "aula", "cupoMax", "nombreDocente", "valid_from", "valid_to", "es_actual"]
    return loaded(t).warehouse.read("dim_dictado").select(columns)


# Enrollments of one student in one offering, of all deliveries, have the smallest id as canonical one; only
# enrollments and exams that come later are mapped, since nobody was merged in the full load.
FACTS_SQL = f"""
    s AS ({STUDENTS_SQL}), d AS ({OFFERINGS_SQL}),
    canon AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, 1 + o_orderkey % 300) AS kept FROM orders),
    changed AS (SELECT id_estudiante, id_dictado, c_mktsegment = '{MOVED_SEGMENT}' OR p_size < {SMALL} AS moved
                FROM s JOIN customer ON c_custkey = id_estudiante CROSS JOIN d JOIN part ON p_partkey = id_dictado),
    e0 AS (SELECT * FROM ({FIRST_ENROLLMENTS_SQL}) SEMI JOIN s USING (id_estudiante) SEMI JOIN d USING (id_dictado)),
    e1 AS (SELECT * FROM ({LATER_ENROLLMENTS_SQL}) JOIN canon ON id = id_inscripcion AND kept = id SEMI JOIN s USING (id_estudiante) SEMI JOIN d USING (id_dictado)),
    f0 AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY id_estudiante, id_dictado ORDER BY id_inscripcion DESC) = 1),
    x0 AS (SELECT id_estudiante, id_dictado, fecha, nota, numero_intento, coalesce(resultado = 'Aprobado', FALSE) AS aprobado
           FROM ({FIRST_EXAMS_SQL}) JOIN e0 USING (id_inscripcion)
           QUALIFY row_number() OVER (PARTITION BY id_estudiante, id_dictado, numero_intento ORDER BY fecha DESC, id_examen DESC) = 1),
    history AS (SELECT id_estudiante, id_dictado, count(*) AS n, bool_or(aprobado) AS done FROM x0 GROUP BY ALL),
    owned AS (SELECT x.*, o.id_estudiante, o.id_dictado, coalesce(resultado = 'Aprobado', FALSE) AS aprobado, c.moved
              FROM ({LATER_EXAMS_SQL}) x JOIN canon ON canon.id = x.id_inscripcion JOIN ({ENROLLMENTS_SQL}) o ON o.id_inscripcion = canon.kept
              JOIN changed c ON c.id_estudiante = o.id_estudiante AND c.id_dictado = o.id_dictado),
    still AS (SELECT o.*, coalesce(h.n, 0) AS n FROM owned o LEFT JOIN history h
              ON h.id_estudiante = o.id_estudiante AND h.id_dictado = o.id_dictado AND NOT o.moved WHERE NOT coalesce(h.done, FALSE)),
    daily AS (SELECT * FROM still QUALIFY row_number() OVER (PARTITION BY id_estudiante, id_dictado, fecha ORDER BY id_examen) = 1),
    chain AS (SELECT *, max(CAST(aprobado AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
                     n + row_number() OVER w AS attempt FROM daily WINDOW w AS (PARTITION BY id_estudiante, id_dictado ORDER BY fecha)),
    x1 AS (SELECT * FROM chain WHERE coalesce(before, 0) = 0)
"""


@query(
    "load_fact_inscripcion",
    f"""
    WITH {FACTS_SQL},
    hit AS (SELECT e1.* FROM e1 JOIN changed USING (id_estudiante, id_dictado) SEMI JOIN f0 USING (id_estudiante, id_dictado) WHERE NOT moved)
    SELECT id_estudiante AS idalumno, id_dictado AS "idDictado", {q.DATE_KEY_SQL.format("f0.fecha_inscripcion")} AS "tiempoSKey",
           CASE WHEN hit.id_inscripcion IS NULL THEN f0.estado ELSE hit.estado END AS estado,
           coalesce(CASE WHEN hit.id_inscripcion IS NULL THEN f0.estado ELSE hit.estado END = 'Abandonada', FALSE) AS abandono
    FROM f0 LEFT JOIN hit USING (id_estudiante, id_dictado)
    UNION ALL SELECT id_estudiante, id_dictado, {q.DATE_KEY_SQL.format("fecha_inscripcion")}, estado, coalesce(estado = 'Abandonada', FALSE)
    FROM e1 ANTI JOIN hit USING (id_inscripcion)
    """,
)
def load_fact_inscripcion(t: Tables) -> DataFrame:
    return natural_keys(t, "fact_inscripcion").select("idalumno", "idDictado", "tiempoSKey", "estado", "abandono")


def natural_keys(t: Tables, table: str) -> DataFrame:
    warehouse = loaded(t).warehouse
    fact = warehouse.read(table).join(warehouse.read("dim_dictado").select("dictadoSKey", "idDictado"), "dictadoSKey")
    if "alumnoSKey" not in fact.columns:
        return fact
    return fact.join(warehouse.read("dim_estudiante").select("alumnoSKey", "idalumno"), "alumnoSKey")


@query(
    "load_fact_examen",
    f"""
    WITH {FACTS_SQL},
    hit AS (SELECT x1.* FROM x1 JOIN x0 ON x0.id_estudiante = x1.id_estudiante AND x0.id_dictado = x1.id_dictado AND x0.numero_intento = x1.attempt
            WHERE NOT x1.moved)
    SELECT x0.id_estudiante AS idalumno, x0.id_dictado AS "idDictado", {q.DATE_KEY_SQL.format("x0.fecha")} AS "tiempoSKey",
           CAST(CAST(coalesce(hit.nota, x0.nota) AS DECIMAL(4,2)) AS DOUBLE) AS nota, x0.numero_intento AS "nroIntentos", coalesce(hit.aprobado, x0.aprobado) AS aprobado
    FROM x0 LEFT JOIN hit ON hit.id_estudiante = x0.id_estudiante AND hit.id_dictado = x0.id_dictado AND hit.attempt = x0.numero_intento
    UNION ALL SELECT id_estudiante, id_dictado, {q.DATE_KEY_SQL.format("fecha")}, CAST(CAST(nota AS DECIMAL(4,2)) AS DOUBLE), attempt, aprobado
    FROM x1 ANTI JOIN hit USING (id_examen)
    """,
)
def load_fact_examen(t: Tables) -> DataFrame:
    return natural_keys(t, "fact_examen_estudiante").select(
        "idalumno", "idDictado", "tiempoSKey", F.col("nota").cast("double").alias("nota"), F.col("nroIntentos").cast("bigint").alias("nroIntentos"), "aprobado"
    )


EVALUATION_DAY_SQL = """CASE WHEN p_partkey IS NULL THEN {0} WHEN p_partkey % 2 = 0 THEN DATE '2020-07-15' ELSE DATE '2020-12-15' END"""
DELIVERED_SQL = f"CASE WHEN event_type = '{LATE_EVENT}' THEN DATE '{LATER.date()}' ELSE DATE '{FIRST.date()}' END"


@query(
    "load_fact_evaluacion",
    f"""
    WITH d AS ({OFFERINGS_SQL})
    SELECT user_id AS "idDictado", {q.DATE_KEY_SQL.format(EVALUATION_DAY_SQL.format("NULL"))} AS "tiempoSKey", CAST(CAST(value AS DECIMAL(5,2)) AS DOUBLE) AS "notaDictado",
           CAST(CAST(value AS DECIMAL(5,2)) AS DOUBLE) AS "notaCont", CASE WHEN event_type <> 'click' THEN CAST(CAST(value AS DECIMAL(5,2)) AS DOUBLE) END AS "notaGeneral"
    FROM events JOIN part ON p_partkey = user_id WHERE user_id IN (SELECT id_dictado FROM d)
    """,
)
def load_fact_evaluacion(t: Tables) -> DataFrame:
    return natural_keys(t, "fact_evaluacion_dictado").select(
        "idDictado", "tiempoSKey", *[F.col(c).cast("double").alias(c) for c in ("notaDictado", "notaCont", "notaGeneral")]
    )


@query(
    "load_dim_tiempo",
    f"""
    WITH canon AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, 1 + o_orderkey % 300) AS kept FROM orders),
    days AS (SELECT fecha_inscripcion AS fecha FROM ({FIRST_ENROLLMENTS_SQL})
             UNION SELECT fecha_inscripcion FROM ({LATER_ENROLLMENTS_SQL}) JOIN canon ON id = id_inscripcion AND kept = id
             UNION SELECT fecha FROM ({FIRST_EXAMS_SQL}) UNION SELECT fecha FROM ({LATER_EXAMS_SQL})
             UNION SELECT {EVALUATION_DAY_SQL.format(DELIVERED_SQL)} FROM events LEFT JOIN part ON p_partkey = user_id WHERE user_id IS NOT NULL)
    SELECT {q.DATE_KEY_SQL.format("fecha")} AS "tiempoSKey", fecha, CAST(day(fecha) AS INTEGER) AS dia, CAST(year(fecha) AS INTEGER) AS ano FROM days
    """,
)
def load_dim_tiempo(t: Tables) -> DataFrame:
    return loaded(t).warehouse.read("dim_tiempo").select("tiempoSKey", "fecha", "dia", "ano")


@query(
    "load_surrogate_keys",
    """
    SELECT unnest(['dim_estudiante', 'dim_dictado', 'fact_inscripcion', 'fact_examen_estudiante', 'fact_evaluacion_dictado']) AS tabla,
           1 AS primera, TRUE AS densa, TRUE AS unica
    """,
)
def load_surrogate_keys(t: Tables) -> DataFrame:
    """Keys of every table run from 1 without a gap over both loads."""
    warehouse = loaded(t).warehouse
    checked = [checked_keys(warehouse.read(table), key, table) for table, key in warehouse.numbered.items()]
    return reduce(DataFrame.unionByName, checked)


@query(
    "load_table_report",
    f"""
    WITH {FACTS_SQL}, v AS (SELECT user_id FROM events WHERE event_type <> '{LATE_EVENT}' AND user_id IS NOT NULL)
    SELECT 'dim_estudiante' AS tabla, (SELECT count(*) FROM s) AS validos, 0 AS rechazados, (SELECT count(*) FROM s) AS final
    UNION ALL SELECT 'dim_dictado', (SELECT count(*) FROM d), 0, (SELECT count(*) FROM d)
    UNION ALL SELECT 'fact_inscripcion', (SELECT count(*) FROM f0), (SELECT count(*) FROM ({FIRST_ENROLLMENTS_SQL})) - (SELECT count(*) FROM e0), (SELECT count(*) FROM f0)
    UNION ALL SELECT 'fact_evaluacion_dictado', (SELECT count(*) FROM v WHERE user_id IN (SELECT id_dictado FROM d)),
                     (SELECT count(*) FROM v WHERE user_id NOT IN (SELECT id_dictado FROM d)), (SELECT count(*) FROM v WHERE user_id IN (SELECT id_dictado FROM d))
    """,
)
def load_table_report(t: Tables) -> DataFrame:
    """Rows kept, turned away and stored by the full load."""
    told = loaded(t).full.tables.where(~F.col("tabla").isin("dim_tiempo", "fact_examen_estudiante"))
    return told.select("tabla", "validos", "rechazados", "final")


@query(
    "load_audit_log",
    f"""
    SELECT 1 AS id, 'OK' AS estado, 0 AS registros_delta, CAST(NULL AS TIMESTAMP) AS ultima_extraccion, TIMESTAMP '{FIRST}' AS nueva_extraccion, 1 AS version_staging
    UNION ALL SELECT 2, 'OK', {" + ".join(LATER_ROWS.values())}, TIMESTAMP '{FIRST}', TIMESTAMP '{LATER}', {2 + len(LATER_RENDERED)}
    """,
)
def load_audit_log(t: Tables) -> DataFrame:
    """Both runs with their watermarks; staging was published by each load and by each delivery."""
    return loaded(t).audit.runs().select("id", "estado", "registros_delta", "ultima_extraccion", "nueva_extraccion", "version_staging")


@query(
    "load_counters",
    f"""
    WITH {FACTS_SQL}, m AS (SELECT count(*) AS n FROM s JOIN customer ON c_custkey = id_estudiante WHERE c_mktsegment = '{MOVED_SEGMENT}'),
    w AS (SELECT count(*) AS n FROM s JOIN customer ON c_custkey = id_estudiante WHERE c_mktsegment = '{NEW_SEGMENT}'),
    o AS (SELECT count(*) FILTER (WHERE p_size < {SMALL}) AS turned, count(*) FILTER (WHERE p_size > {BIG}) AS roomed FROM d JOIN part ON p_partkey = id_dictado),
    hi AS (SELECT count(*) AS n FROM e1 JOIN changed USING (id_estudiante, id_dictado) SEMI JOIN f0 USING (id_estudiante, id_dictado) WHERE NOT moved),
    hx AS (SELECT count(*) AS n FROM x1 JOIN x0 ON x0.id_estudiante = x1.id_estudiante AND x0.id_dictado = x1.id_dictado
           AND x0.numero_intento = x1.attempt WHERE NOT x1.moved)
    SELECT 'estudiantes.insertados' AS contador, m.n + w.n AS valor FROM m, w
    UNION ALL SELECT 'estudiantes.actualizados_scd2', n FROM m
    UNION ALL SELECT 'dictados.insertados', turned FROM o UNION ALL SELECT 'dictados.actualizados_scd2', turned FROM o
    UNION ALL SELECT 'dictados.actualizados_scd1', roomed FROM o
    UNION ALL SELECT 'fact_inscripcion.actualizados', n FROM hi
    UNION ALL SELECT 'fact_inscripcion.insertados', (SELECT count(*) FROM e1) - n FROM hi
    UNION ALL SELECT 'fact_examen_estudiante.actualizados', n FROM hx
    UNION ALL SELECT 'fact_examen_estudiante.insertados', (SELECT count(*) FROM x1) - n FROM hx
    UNION ALL SELECT 'historial.aceptados', count(*) FROM x1
    """,
)
def load_counters(t: Tables) -> DataFrame:
    """What the incremental run reports."""
    told = loaded(t).later
    values = [("estudiantes", told.students, ("insertados", "actualizados_scd2"))]
    values += [("dictados", told.offerings, ("insertados", "actualizados_scd2", "actualizados_scd1"))]
    values += [(f, told.facts[f], ("insertados", "actualizados")) for f in ("fact_inscripcion", "fact_examen_estudiante")]
    values += [("historial", told.history, ("aceptados",))]
    rows = [(f"{name}.{c}", counts[c]) for name, counts, columns in values for c in columns]
    return t.spark.createDataFrame(rows, "contador string, valor bigint")


@query("load_enrollment_map", "SELECT id AS id_repetido, kept AS id_tomado FROM (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, 1 + o_orderkey % 300) AS kept FROM orders) WHERE id <> kept")
def load_enrollment_map(t: Tables) -> DataFrame:
    """The map of repeated enrollments that staging holds after both deliveries."""
    return loaded(t).staging.read("stg_inscripciones_repetidas")
