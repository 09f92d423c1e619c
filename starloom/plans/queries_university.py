"""Queries through the production entities and builders of the university warehouse.

The given tables are rendered as staging text: regions stand for faculties, nations
for departments and programmes, parts for courses and offerings, suppliers for
teachers, customers for students, orders for enrollments, line items for exams and
events for evaluations. Every row is staged twice where a table is small, the second
time with other values, so that keep-first matters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators import facts, scd
from starloom.plans import university as u
from starloom.plans.queries_cleaning import TITLE_SQL
from starloom.plans.registry import REGISTRY, Tables
from starloom.sources.staging import academic_calendar, add_evaluation_date

query = REGISTRY.query

AS_OF = dt.date(2025, 1, 1)
SECOND = 1 << 40


def raw(df: DataFrame, row_id: Column, **columns: Column | str) -> DataFrame:
    """Rows as staging text under their source column names."""
    made = {c: F.lit(v) if isinstance(v, str) else v for c, v in columns.items()}
    return df.select(row_id.cast("bigint").alias("row_id"), *[v.cast("string").alias(f"{c}_raw") for c, v in made.items()])


def twice(df: DataFrame, *changed: str) -> DataFrame:
    """The rows, and again later with other values in some columns."""
    later = df.withColumn("row_id", F.col("row_id") + SECOND).withColumns({c: F.lit("otro") for c in changed})
    return df.unionByName(later)


def cleaned(entity: str, df: DataFrame) -> DataFrame:
    return u.ENTITIES[entity].clean(df).drop("row_id")


def faculties(t: Tables) -> DataFrame:
    name = F.lower("r_name")
    rows = raw(
        t.region, F.col("r_regionkey"), id_facultad=F.concat(F.lit(" "), F.col("r_regionkey").cast("string")),
        nombre=F.concat(F.lit("\t"), name, F.lit(" ")), ciudad=F.upper(name), provincia=F.when(F.col("r_regionkey") != 2, name),
    )
    return twice(rows, "nombre_raw", "ciudad_raw")


FACULTIES_SQL = f"""
    SELECT CAST(r_regionkey AS BIGINT) AS id_facultad, {TITLE_SQL.format("r_name")} AS nombre_facultad,
           {TITLE_SQL.format("r_name")} AS ciudad_facultad,
           CASE WHEN r_regionkey <> 2 THEN {TITLE_SQL.format("r_name")} END AS provincia_facultad
    FROM region
"""


@query("entity_faculties", FACULTIES_SQL)
def entity_faculties(t: Tables) -> DataFrame:
    return cleaned("facultades", faculties(t))


def departments(t: Tables) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 7 != 6, F.col("n_name"))
    return twice(raw(t.nation, F.col("n_nationkey"), id_departamento=F.col("n_nationkey"), nombre=name, id_facultad=F.col("n_regionkey")))


DEPARTMENTS_SQL = f"""
    SELECT CAST(n_nationkey AS BIGINT) AS id_departamento, {TITLE_SQL.format("n_name")} AS nombre_departamento,
           CAST(n_regionkey AS BIGINT) AS id_facultad
    FROM nation WHERE n_nationkey % 7 <> 6
"""


@query("entity_departments", DEPARTMENTS_SQL)
def entity_departments(t: Tables) -> DataFrame:
    return cleaned("departamentos", departments(t))


def programmes(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    rows = raw(
        t.nation, key, id_programa=key, nombre=F.concat(F.lit("lic. en "), F.lower("n_name")),
        tipo=F.when(key % 2 == 0, F.lit("GRADO")).otherwise("pre-grado"), duracion_anios=F.concat((3 + key % 3).cast("string"), F.lit(" ")),
        id_facultad=F.when(key % 5 != 0, F.col("n_regionkey").cast("string")).otherwise("s/d"),
    )
    return twice(rows, "tipo_raw")


PROGRAMMES_SQL = f"""
    SELECT CAST(n_nationkey AS BIGINT) AS id_programa, {TITLE_SQL.format("'lic. en ' || n_name")} AS nombre_programa,
           CASE WHEN n_nationkey % 2 = 0 THEN 'Grado' ELSE 'Pre-Grado' END AS tipo_programa,
           CAST(3 + n_nationkey % 3 AS BIGINT) AS duracion_anios_programa,
           CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_regionkey AS BIGINT) END AS id_facultad
    FROM nation
"""


@query("entity_programmes", PROGRAMMES_SQL)
def entity_programmes(t: Tables) -> DataFrame:
    return cleaned("programas", programmes(t))


def courses(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = raw(
        t.part, key, id_curso=F.format_number(key, 0), codigo=F.lower("p_brand"), nombre=F.when(key % 11 != 3, F.upper("p_name")),
        horas_teorica=size - 25, horas_ejercicios=size, horas_laboratorio="n/a", nivel=F.concat(F.lit("+"), (size % 6).cast("string")),
    )
    return twice(rows, "codigo_raw")


COURSES_SQL = f"""
    SELECT p_partkey AS id_curso, {TITLE_SQL.format("p_brand")} AS codigo_curso, {TITLE_SQL.format("p_name")} AS nombre_curso,
           CASE WHEN p_size >= 25 THEN CAST(p_size - 25 AS BIGINT) END AS horas_teo_curso, CAST(p_size AS BIGINT) AS horas_prac_curso,
           CAST(NULL AS BIGINT) AS horas_lab_curso, CAST(p_size % 6 AS BIGINT) AS nivel_curso
    FROM part WHERE p_partkey % 11 <> 3
"""


@query("entity_courses", COURSES_SQL)
def entity_courses(t: Tables) -> DataFrame:
    return cleaned("cursos", courses(t))


def teachers(t: Tables) -> DataFrame:
    rows = raw(
        t.supplier, F.col("s_suppkey"), id_docente=F.col("s_suppkey"), apellido=F.upper("s_name"),
        nombre=F.when(F.col("s_acctbal") >= 0, F.lit(" maría josé")), titulo="DR.", categoria="titular", dedicacion="semi-exclusiva",
        id_departamento=F.col("s_nationkey"),
    )
    return twice(rows, "titulo_raw", "id_departamento_raw")


TEACHERS_SQL = f"""
    SELECT s_suppkey AS id_docente, {TITLE_SQL.format("s_name")} AS apellido_docente, 'María José' AS nombre_docente, 'Dr.' AS titulo_docente,
           'Titular' AS categoria_docente, 'Semi-Exclusiva' AS dedicacion_docente, CAST(s_nationkey AS BIGINT) AS id_departamento
    FROM supplier WHERE s_acctbal >= 0
"""


@query("entity_teachers", TEACHERS_SQL)
def entity_teachers(t: Tables) -> DataFrame:
    return cleaned("docentes", teachers(t))


def students(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    dni = F.when(key % 10 != 0, F.translate(F.format_number(1000000 + key * 7, 0), ",", ".")).otherwise("12.345")
    born = F.date_add(F.lit(dt.date(1990, 1, 1)), (key % 4000).cast("int"))
    rows = raw(
        t.customer, key, id_estudiante=key, dni=dni, apellido=F.upper("c_name"), nombre=F.lower("c_mktsegment"),
        genero=F.when(key % 3 == 0, "masculino").when(key % 3 == 1, " F").otherwise("x"), fecha_nacimiento=F.date_format(born, "dd/MM/yyyy"),
        email="a@b", telefono="1", nacionalidad=F.when(key % 4 != 0, F.lit("Argentina")), id_programa=F.col("c_nationkey"),
        anio_ingreso=2008 + key % 12,
    )
    return twice(rows, "nombre_raw", "genero_raw", "dni_raw")


STUDENTS_SQL = f"""
    SELECT c_custkey AS id_estudiante, 1000000 + c_custkey * 7 AS dni, {TITLE_SQL.format("c_name")} AS apellido,
           {TITLE_SQL.format("c_mktsegment")} AS nombre, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS genero,
           DATE '1990-01-01' + CAST(c_custkey % 4000 AS INTEGER) AS fecha_nacimiento,
           CASE WHEN c_custkey % 4 <> 0 THEN 'Argentina' ELSE 'No especificado' END AS nacionalidad,
           CAST(c_nationkey AS BIGINT) AS id_programa, CAST(2008 + c_custkey % 12 AS BIGINT) AS anio_ingreso
    FROM customer WHERE c_custkey % 10 <> 0
"""


@query("entity_students", STUDENTS_SQL)
def entity_students(t: Tables) -> DataFrame:
    return cleaned("estudiantes", students(t))


@query(
    "entity_student_rejects",
    f"""
    SELECT c_custkey AS row_id, c_custkey AS id_estudiante, CAST(12345 AS BIGINT) AS dni FROM customer WHERE c_custkey % 10 = 0
    UNION ALL SELECT c_custkey + {SECOND}, c_custkey, NULL FROM customer
    """,
)
def entity_student_rejects(t: Tables) -> DataFrame:
    return u.ENTITIES["estudiantes"].rejects(students(t)).select("row_id", "id_estudiante", "dni")


def offerings(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    rows = raw(
        t.part, key, id_dictado=key, id_curso=F.when(key % 13 != 5, key), id_docente=1 + key % 50, id_programa=key % 25, anio_academico="2020",
        periodo=F.when(key % 2 == 0, "c1").otherwise("C2"), turno="MAÑANA", aula=F.concat(F.lit("lab-a"), (key % 9).cast("string")),
        cupo_maximo=F.col("p_size") - 10,
    )
    return twice(rows, "aula_raw")


OFFERINGS_SQL = """
    SELECT p_partkey AS id_dictado, p_partkey AS id_curso, 1 + p_partkey % 50 AS id_docente, p_partkey % 25 AS id_programa,
           CASE WHEN p_partkey % 2 = 0 THEN 'C1' ELSE 'C2' END AS periodo, 'Mañana' AS turno, 'Lab-A' || p_partkey % 9 AS aula,
           CASE WHEN p_size >= 10 THEN CAST(p_size - 10 AS BIGINT) END AS cupo_maximo
    FROM part WHERE p_partkey % 13 <> 5
"""


@query("entity_offerings", OFFERINGS_SQL)
def entity_offerings(t: Tables) -> DataFrame:
    return cleaned("dictados", offerings(t))


def enrollments(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "ABANDONADA").when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise("activa")
    return raw(
        t.orders, key, id_inscripcion=key, id_estudiante=F.col("o_custkey"), id_dictado=1 + key % 300,
        fecha_inscripcion=F.when(key % 17 != 4, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("31/02/2020"), estado=state,
    )


ENROLLMENTS_SQL = """
    SELECT o_orderkey AS id_inscripcion, o_custkey AS id_estudiante, 1 + o_orderkey % 300 AS id_dictado,
           CAST(o_orderdate AS DATE) AS fecha_inscripcion, CASE o_orderstatus WHEN 'F' THEN 'Abandonada' WHEN 'O' THEN 'Activa' END AS estado
    FROM orders WHERE o_orderkey % 17 <> 4
"""


@query("entity_enrollments", ENROLLMENTS_SQL)
def entity_enrollments(t: Tables) -> DataFrame:
    return cleaned("inscripciones", enrollments(t))


def exam_order() -> Column:
    """The row number of a line item, by part, supplier and day."""
    days = F.datediff(F.to_date("l_shipdate"), F.lit(dt.date(1970, 1, 1)))
    return (F.col("l_partkey") * 1000000 + F.col("l_suppkey")) * 100000 + days


def exams(t: Tables) -> DataFrame:
    """Line items as exams; their number repeats, so the first of each is kept."""
    return raw(
        t.lineitem, exam_order(), id_examen=F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        id_inscripcion=F.col("l_orderkey"), fecha=F.date_format("l_shipdate", "dd-MM-yyyy"),
        nota=F.translate((F.col("l_quantity") / 4).cast("decimal(6,2)").cast("string"), ".", ","), numero_intento=F.col("l_linenumber") - 1,
        resultado=F.when(F.col("l_returnflag") == "A", "APROBADO").when(F.col("l_returnflag") == "N", F.lit(None)).otherwise("desaprobado"),
    )


EXAMS_SQL = """
    SELECT l_orderkey * 10 + l_linenumber AS id_examen, l_orderkey AS id_inscripcion, CAST(l_shipdate AS DATE) AS fecha,
           CAST(CAST(l_quantity / 4 AS DECIMAL(6,2)) AS DOUBLE) AS nota, CAST(l_linenumber - 1 AS BIGINT) AS numero_intento,
           CASE l_returnflag WHEN 'A' THEN 'Aprobado' WHEN 'R' THEN 'Desaprobado' END AS resultado
    FROM lineitem WHERE l_quantity / 4 <= 10 AND l_linenumber > 1
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) = 1
"""


@query("entity_exams", EXAMS_SQL)
def entity_exams(t: Tables) -> DataFrame:
    return cleaned("examenes", exams(t))


@query(
    "entity_exam_accounting",
    f"""
    WITH v AS (SELECT count(*) AS n FROM lineitem WHERE l_quantity / 4 <= 10 AND l_linenumber > 1), k AS (SELECT count(*) AS n FROM ({EXAMS_SQL}))
    SELECT 'stg_examen' AS tabla, (SELECT count(*) FROM lineitem) AS total, k.n AS validos, (SELECT count(*) FROM lineitem) - v.n AS rechazados,
           v.n - k.n AS duplicados
    FROM v, k
    """,
)
def entity_exam_accounting(t: Tables) -> DataFrame:
    return u.ENTITIES["examenes"].accounting(exams(t))


def evaluations(t: Tables) -> DataFrame:
    value = F.col("value").cast("decimal(12,2)").cast("string")
    return raw(
        t.events, F.col("event_id"), id_evaluacion=F.col("event_id"), id_dictado=F.col("user_id"), fecha_evaluacion=F.date_format("ts", "yyyy/MM/dd"),
        puntaje_dictado=value, puntaje_contenido=F.translate(value, ".", ","), valoracion_general=F.when(F.col("event_type") == "click", "s/d").otherwise(value),
    )


EVALUATIONS_SQL = """
    SELECT event_id AS id_evaluacion, user_id AS id_dictado, CAST(ts AS DATE) AS fecha_evaluacion,
           CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS puntaje_dictado, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS puntaje_contenido,
           CASE WHEN event_type <> 'click' THEN CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) END AS valoracion_general
    FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL
"""


@query("entity_evaluations", EVALUATIONS_SQL)
def entity_evaluations(t: Tables) -> DataFrame:
    return cleaned("evaluaciones", evaluations(t))


DIM_STUDENT_SQL = f"""
    WITH s AS ({STUDENTS_SQL}), p AS ({PROGRAMMES_SQL})
    SELECT id_estudiante AS idalumno, dni, nombre, apellido, genero, fecha_nacimiento AS "fechaNacim", nacionalidad,
           anio_ingreso AS "anioIngreso",
           CASE WHEN anio_ingreso - year(fecha_nacimiento) BETWEEN 0 AND 120 THEN CAST(anio_ingreso - year(fecha_nacimiento) AS INTEGER) END AS "edadIngreso",
           FALSE AS "egresoCarrera", CAST(NULL AS INTEGER) AS "anioEgreso", FALSE AS "abandonoCarrera", CAST(NULL AS INTEGER) AS "anioAbandono",
           nombre_programa AS "nombrePrograma", tipo_programa AS "tipoPrograma", duracion_anios_programa AS "duracionAniosPrograma",
           CAST(NULL AS INTEGER) AS "anioPlanPrograma", DATE '2025-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, TRUE AS es_actual
    FROM s LEFT JOIN p USING (id_programa)
"""


def dim_student(t: Tables) -> DataFrame:
    clean = {name: u.ENTITIES[name].clean(df) for name, df in (("estudiantes", students(t)), ("programas", programmes(t)))}
    return u.student_dimension(clean["estudiantes"], clean["programas"], AS_OF)


@query("build_dim_estudiante", DIM_STUDENT_SQL)
def build_dim_estudiante(t: Tables) -> DataFrame:
    return dim_student(t).drop("row_id")


DIM_OFFERING_SQL = f"""
    WITH d AS ({OFFERINGS_SQL}), c AS ({COURSES_SQL}), t AS ({TEACHERS_SQL}), p AS ({DEPARTMENTS_SQL}), f AS ({FACULTIES_SQL})
    SELECT id_dictado AS "idDictado", periodo, turno, aula, cupo_maximo AS "cupoMax", codigo_curso AS "codigoCurso", nombre_curso AS "nombreCurso",
           horas_teo_curso AS "horasTeoCurso", horas_prac_curso AS "horasPracCurso", horas_lab_curso AS "horasLabCurso",
           nivel_curso AS "nivelCurso", nombre_docente AS "nombreDocente", apellido_docente AS "apellidoDocente",
           titulo_docente AS "tituloDocente", categoria_docente AS "categoriaDocente", dedicacion_docente AS "dedicacionDocente",
           nombre_departamento AS "nombreDep", nombre_facultad AS "nombreFac", ciudad_facultad AS "ciudadFac", provincia_facultad AS "provFac",
           DATE '2025-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, TRUE AS es_actual
    FROM d LEFT JOIN c USING (id_curso) LEFT JOIN t USING (id_docente) LEFT JOIN p ON p.id_departamento = t.id_departamento
    LEFT JOIN f ON f.id_facultad = p.id_facultad
"""


def dim_offering(t: Tables) -> DataFrame:
    staged = {"cursos": courses(t), "docentes": teachers(t), "departamentos": departments(t), "facultades": faculties(t)}
    lookups = {name: u.ENTITIES[name].clean(df) for name, df in staged.items()}
    return u.offering_dimension(u.ENTITIES["dictados"].clean(offerings(t)), lookups, AS_OF)


@query("build_dim_dictado", DIM_OFFERING_SQL)
def build_dim_dictado(t: Tables) -> DataFrame:
    return dim_offering(t).drop("row_id")


def student_keys(t: Tables) -> facts.KeyLookup:
    return u.student_keys(dim_student(t).withColumn("alumnoSKey", F.col("idalumno") + 5000000))


def offering_keys(t: Tables) -> facts.KeyLookup:
    return u.offering_keys(dim_offering(t).withColumn("dictadoSKey", F.col("idDictado") + 7000000))


DATE_KEY_SQL = "CAST(year({0}) * 10000 + month({0}) * 100 + day({0}) AS INTEGER)"
KNOWN_SQL = f"s AS ({STUDENTS_SQL}), d AS ({OFFERINGS_SQL}), e AS ({ENROLLMENTS_SQL})"


@query(
    "build_fact_inscripcion",
    f"""
    WITH {KNOWN_SQL}
    SELECT id_estudiante + 5000000 AS "alumnoSKey", {DATE_KEY_SQL.format("fecha_inscripcion")} AS "tiempoSKey", id_dictado + 7000000 AS "dictadoSKey",
           estado, coalesce(estado = 'Abandonada', FALSE) AS abandono
    FROM e SEMI JOIN s USING (id_estudiante) SEMI JOIN d USING (id_dictado)
    QUALIFY row_number() OVER (PARTITION BY id_estudiante, id_dictado ORDER BY id_inscripcion DESC) = 1
    """,
)
def build_fact_inscripcion(t: Tables) -> DataFrame:
    return u.enrollment_fact(u.ENTITIES["inscripciones"].clean(enrollments(t)), student_keys(t), offering_keys(t))


@query(
    "build_fact_examen",
    f"""
    WITH {KNOWN_SQL}, x AS ({EXAMS_SQL})
    SELECT id_estudiante + 5000000 AS "alumnoSKey", {DATE_KEY_SQL.format("fecha")} AS "tiempoSKey", id_dictado + 7000000 AS "dictadoSKey", nota,
           numero_intento AS "nroIntentos", coalesce(resultado = 'Aprobado', FALSE) AS aprobado
    FROM x JOIN e USING (id_inscripcion) SEMI JOIN s USING (id_estudiante) SEMI JOIN d USING (id_dictado)
    QUALIFY row_number() OVER (PARTITION BY id_estudiante, id_dictado, numero_intento ORDER BY fecha DESC, id_examen DESC) = 1
    """,
)
def build_fact_examen(t: Tables) -> DataFrame:
    marked = u.with_passed(u.ENTITIES["examenes"].clean(exams(t)))
    owned = u.own_exams(marked, u.ENTITIES["inscripciones"].clean(enrollments(t)))
    return u.exam_fact(facts.resolve_keys(owned, [student_keys(t), offering_keys(t)]))


@query(
    "build_fact_evaluacion",
    f"""
    WITH d AS ({OFFERINGS_SQL}), v AS ({EVALUATIONS_SQL})
    SELECT id_dictado + 7000000 AS "dictadoSKey", {DATE_KEY_SQL.format("fecha_evaluacion")} AS "tiempoSKey", puntaje_dictado AS "notaDictado",
           puntaje_contenido AS "notaCont", valoracion_general AS "notaGeneral"
    FROM v SEMI JOIN d USING (id_dictado)
    """,
)
def build_fact_evaluacion(t: Tables) -> DataFrame:
    return u.evaluation_fact(u.ENTITIES["evaluaciones"].clean(evaluations(t)), offering_keys(t))


@query(
    "build_fact_evaluacion_once",
    f"""
    WITH d AS ({OFFERINGS_SQL}), v AS ({EVALUATIONS_SQL})
    SELECT id_dictado + 7000000 AS "dictadoSKey", {DATE_KEY_SQL.format("fecha_evaluacion")} AS "tiempoSKey", puntaje_dictado AS "notaDictado",
           puntaje_contenido AS "notaCont", valoracion_general AS "notaGeneral"
    FROM v SEMI JOIN d USING (id_dictado)
    QUALIFY row_number() OVER (PARTITION BY id_dictado, fecha_evaluacion ORDER BY id_evaluacion) = 1
    """,
)
def build_fact_evaluacion_once(t: Tables) -> DataFrame:
    clean = u.ENTITIES["evaluaciones"].clean(evaluations(t))
    return u.evaluation_fact(clean, offering_keys(t), once_per=["dictadoSKey", "tiempoSKey"])


def changed_students(t: Tables) -> DataFrame:
    """A delta: some programmes and genders differ from the stored ones, some students are new."""
    key = F.col("idalumno")
    return (
        dim_student(t)
        .drop("row_id")
        .withColumn("idalumno", F.when(key % 7 == 1, key + 10000000).otherwise(key))
        .withColumn("tipoPrograma", F.when(key % 7 == 2, F.lit("Posgrado")).otherwise(F.col("tipoPrograma")))
        .withColumn("genero", F.when(key % 7 == 3, F.lit("X")).otherwise(F.col("genero")))
        .withColumn("nombre", F.lit("Ignorado"))
    )


@query(
    "policy_student_actions",
    f"""
    WITH s AS ({STUDENTS_SQL})
    SELECT CASE WHEN id_estudiante % 7 = 1 THEN id_estudiante + 10000000 ELSE id_estudiante END AS idalumno,
           CASE WHEN id_estudiante % 7 = 1 THEN NULL ELSE id_estudiante + 5000000 END AS current_key,
           CASE id_estudiante % 7 WHEN 1 THEN 'insert' WHEN 2 THEN 'new_version' WHEN 3 THEN 'update' ELSE 'same' END AS action
    FROM s
    """,
)
def policy_student_actions(t: Tables) -> DataFrame:
    stored = dim_student(t).withColumn("alumnoSKey", F.col("idalumno") + 5000000)
    marked = scd.classify(stored, changed_students(t), u.STUDENT_POLICY)
    return marked.select("idalumno", F.col("_old_alumnoSKey").alias("current_key"), F.col("_action").alias("action"))


@query(
    "policy_offering_actions",
    f"""
    WITH d AS ({DIM_OFFERING_SQL})
    SELECT "idDictado", CASE "idDictado" % 5 WHEN 0 THEN 'new_version' WHEN 1 THEN 'update' ELSE 'same' END AS action FROM d
    """,
)
def policy_offering_actions(t: Tables) -> DataFrame:
    stored = dim_offering(t).withColumn("dictadoSKey", F.col("idDictado") + 7000000)
    key = F.col("idDictado")
    delta = (
        dim_offering(t)
        .drop("row_id")
        .withColumn("turno", F.when(key % 5 == 0, F.lit("Noche")).otherwise(F.col("turno")))
        .withColumn("aula", F.when(key % 5 == 1, F.lit("Lab-Z")).otherwise(F.col("aula")))
        .withColumn("nombreDep", F.lit("Ignorado"))
    )
    return scd.classify(stored, delta, u.OFFERING_POLICY).select("idDictado", F.col("_action").alias("action"))


@query(
    "evaluation_dates_of_offerings",
    """
    SELECT event_id, CASE WHEN p_partkey IS NULL THEN '2025-01-01' WHEN p_partkey % 2 = 0 THEN '2020-07-15' ELSE '2020-12-15' END AS fecha_evaluacion
    FROM events LEFT JOIN part ON p_partkey = user_id
    """,
)
def evaluation_dates_of_offerings(t: Tables) -> DataFrame:
    calendar = academic_calendar(offerings(t), "id_dictado_raw", "periodo_raw", "anio_academico_raw", ["row_id"])
    spaced = t.events.select("event_id", F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("id_dictado_raw"))
    return add_evaluation_date(spaced, calendar, "id_dictado_raw", AS_OF.isoformat()).select("event_id", "fecha_evaluacion")


@query(
    "evaluations_in_turn",
    f"""
    WITH e AS ({ENROLLMENTS_SQL}),
    h AS (SELECT *, row_number() OVER (PARTITION BY id_dictado ORDER BY id_inscripcion) - 1 AS turn, count(*) OVER (PARTITION BY id_dictado) AS n FROM e),
    v AS (SELECT *, row_number() OVER (PARTITION BY id_dictado ORDER BY id_evaluacion) - 1 AS place FROM ({EVALUATIONS_SQL})),
    c AS (SELECT p_partkey AS id_dictado, CASE WHEN p_partkey % 2 = 0 THEN DATE '2020-07-15' ELSE DATE '2020-12-15' END AS day FROM part WHERE p_size > 25)
    SELECT id_evaluacion, v.id_dictado, h.id_inscripcion, h.id_estudiante, h.id_inscripcion IS NOT NULL AS asignada,
           CASE WHEN h.id_inscripcion IS NOT NULL THEN coalesce(c.day, h.fecha_inscripcion + 90) END AS fecha_evaluacion
    FROM v LEFT JOIN (SELECT DISTINCT id_dictado, n FROM h) s ON s.id_dictado = v.id_dictado
    LEFT JOIN h ON h.id_dictado = v.id_dictado AND h.turn = v.place % s.n LEFT JOIN c ON c.id_dictado = v.id_dictado
    """,
)
def evaluations_in_turn(t: Tables) -> DataFrame:
    """Evaluations given to the students of their offering; only offerings with room for many have a calendar."""
    roomy = offerings(t).where(F.col("cupo_maximo_raw").cast("int") > 15)
    calendar = academic_calendar(roomy, "id_dictado_raw", "periodo_raw", "anio_academico_raw", ["row_id"])
    known = calendar.select(F.col("id_dictado_raw").cast("bigint").alias("id_dictado"), "fecha_evaluacion")
    clean = [u.ENTITIES[name].clean(df).drop("row_id") for name, df in (("evaluaciones", evaluations(t)), ("inscripciones", enrollments(t)))]
    columns = ["id_evaluacion", "id_dictado", "id_inscripcion", "id_estudiante", "asignada", "fecha_evaluacion"]
    return u.evaluations_in_turn(*clean, known).select(columns)
