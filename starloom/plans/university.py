"""The university warehouse: tables, entity rules and dimension policies."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom import functions as fn
from starloom.operators import dimensions, facts, quality
from starloom.operators.cascade import CascadeColumns
from starloom.operators.constraints import Holds, References, Unique
from starloom.operators.dedupe import keep_one
from starloom.operators.joins import flatten_chain, missing_references, skew_safe_join
from starloom.operators.keys import assign_in_turn, current_key_map
from starloom.operators.scd import ScdPolicy

# Columns of each source extract, in file order.
SOURCE_COLUMNS: dict[str, list[str]] = {
    "estudiante": [
        "id_estudiante", "dni", "apellido", "nombre", "genero", "fecha_nacimiento",
        "email", "telefono", "nacionalidad", "id_programa", "anio_ingreso",
    ],
    "docente": ["id_docente", "apellido", "nombre", "titulo", "categoria", "dedicacion", "id_departamento"],
    "dictado": [
        "id_dictado", "id_curso", "id_docente", "id_programa", "anio_academico",
        "periodo", "turno", "aula", "cupo_maximo",
    ],
    "inscripcion": ["id_inscripcion", "id_estudiante", "id_dictado", "fecha_inscripcion", "estado"],
    "examen": ["id_examen", "id_inscripcion", "fecha", "nota", "numero_intento", "resultado"],
    "evaluacion_curso": [
        "id_evaluacion", "id_dictado", "puntaje_dictado", "puntaje_contenido", "valoracion_general",
    ],
    "facultad": ["id_facultad", "nombre", "ciudad", "provincia"],
    "departamento": ["id_departamento", "nombre", "id_facultad"],
    "programa": ["id_programa", "nombre", "tipo", "duracion_anios", "id_facultad"],
    "curso": [
        "id_curso", "codigo", "nombre", "horas_teorica", "horas_ejercicios",
        "horas_laboratorio", "anio_plan", "nivel",
    ],
    "curso_programa": ["id_curso", "id_programa"],
}

# Warehouse tables.
WAREHOUSE_SCHEMAS = {
    "dim_tiempo": "tiempoSKey int, fecha date, dia int, mes string, ano int, periodoAcademico string, esFeriado boolean",
    "dim_dictado": (
        "dictadoSKey bigint, idDictado bigint, periodo string, turno string, aula string, cupoMax bigint, "
        "codigoCurso string, nombreCurso string, horasTeoCurso bigint, horasPracCurso bigint, "
        "horasLabCurso bigint, nivelCurso bigint, nombreDocente string, apellidoDocente string, "
        "tituloDocente string, categoriaDocente string, dedicacionDocente string, nombreDep string, "
        "nombreFac string, ciudadFac string, provFac string, valid_from date, valid_to date, es_actual boolean"
    ),
    "dim_estudiante": (
        "alumnoSKey bigint, idalumno bigint, dni bigint, nombre string, apellido string, genero string, "
        "fechaNacim date, nacionalidad string, anioIngreso bigint, edadIngreso int, egresoCarrera boolean, "
        "anioEgreso int, abandonoCarrera boolean, anioAbandono int, nombrePrograma string, "
        "tipoPrograma string, duracionAniosPrograma bigint, anioPlanPrograma int, valid_from date, "
        "valid_to date, es_actual boolean"
    ),
    "fact_examen_estudiante": (
        "examAlumSK bigint, alumnoSKey bigint, tiempoSKey int, dictadoSKey bigint, nota decimal(4,2), "
        "nroIntentos int, aprobado boolean"
    ),
    "fact_evaluacion_dictado": (
        "evalDicSKey bigint, dictadoSKey bigint, tiempoSKey int, notaDictado decimal(5,2), "
        "notaCont decimal(5,2), notaGeneral decimal(5,2)"
    ),
    "fact_inscripcion": (
        "InscripSKey bigint, alumnoSKey bigint, tiempoSKey int, dictadoSKey bigint, estado string, abandono boolean"
    ),
}

# Lengths the warehouse allows for text columns.
TEXT_LIMITS = {
    "dim_dictado": {
        "periodo": 2, "turno": 50, "aula": 50, "codigoCurso": 20, "nombreCurso": 100,
        "nombreDocente": 100, "apellidoDocente": 100, "tituloDocente": 100, "categoriaDocente": 100,
        "dedicacionDocente": 100, "nombreDep": 100, "nombreFac": 100, "ciudadFac": 100, "provFac": 100,
    },
    "dim_estudiante": {
        "nombre": 100, "apellido": 100, "genero": 20, "nacionalidad": 50, "nombrePrograma": 100, "tipoPrograma": 50,
    },
    "fact_inscripcion": {"estado": 50},
}

# Unique keys of the facts, and their generated keys.
FACT_KEYS: dict[str, list[str]] = {
    "fact_inscripcion": ["alumnoSKey", "dictadoSKey"],
    "fact_examen_estudiante": ["alumnoSKey", "dictadoSKey", "nroIntentos"],
    "fact_evaluacion_dictado": [],
}
FACT_SURROGATES = {
    "fact_inscripcion": "InscripSKey",
    "fact_examen_estudiante": "examAlumSK",
    "fact_evaluacion_dictado": "evalDicSKey",
}

# Keys, references and conditions of the warehouse tables.
CONSTRAINTS = (
    Unique("dim_tiempo", ("tiempoSKey",)),
    Unique("dim_estudiante", ("alumnoSKey",)),
    Unique("dim_estudiante", ("idalumno",), "es_actual"),
    Holds("dim_estudiante", ("alumnoSKey",), "valid_to >= valid_from"),
    Unique("dim_dictado", ("dictadoSKey",)),
    Unique("dim_dictado", ("idDictado",), "es_actual"),
    Holds("dim_dictado", ("dictadoSKey",), "valid_to >= valid_from"),
    *[Unique(table, tuple(columns)) for table, columns in FACT_KEYS.items() if columns],
    *[
        References(table, (key,), parent, (key,))
        for table, parents in (
            ("fact_inscripcion", ("alumnoSKey", "tiempoSKey", "dictadoSKey")),
            ("fact_examen_estudiante", ("alumnoSKey", "tiempoSKey", "dictadoSKey")),
            ("fact_evaluacion_dictado", ("tiempoSKey", "dictadoSKey")),
        )
        for key in parents
        for parent in ({"alumnoSKey": "dim_estudiante", "tiempoSKey": "dim_tiempo", "dictadoSKey": "dim_dictado"}[key],)
    ],
)

# Enrollment states that count as dropping out.
DROPOUT_STATES = ("abandonada", "abandonado", "abandono", "baja")
PASSED_RESULT = "aprobado"


def staging_name(source: str) -> str:
    return f"stg_{source}"


def _staging_ddl(source: str) -> str:
    columns = list(SOURCE_COLUMNS[source])
    if source == "evaluacion_curso":
        columns.insert(2, "fecha_evaluacion")
    fields = ", ".join(f"{c}_raw string" for c in columns)
    return f"row_id bigint, archivo_origen string, fecha_carga timestamp, {fields}"


STAGING_SCHEMAS = {staging_name(s): _staging_ddl(s) for s in SOURCE_COLUMNS} | {
    name: "id_repetido bigint, id_tomado bigint"
    for name in ("stg_estudiantes_repetidos", "stg_inscripciones_repetidas")
}


@dataclass(frozen=True)
class Entity:
    """How a staging table becomes a typed entity.

    ``columns`` maps each output column to its raw column and cleaner; ``within``
    has the conditions under which cleaned values stay, others becoming null; ``valid``
    is a condition on the cleaned columns beyond ``required`` being present.
    """

    source: str
    key: str
    columns: Mapping[str, tuple[str, Callable[[Column], Column]]]
    required: tuple[str, ...]
    valid: Callable[[], Column] = field(default=lambda: F.lit(True))
    within: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)

    def typed(self, raw: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
        """Every raw row with typed columns and its order number; nothing is dropped.

        The order number goes through an expression that counts as not deterministic,
        with the same value. Filters on cleaned columns then stay above the cleaning, where
        Catalyst would otherwise push them below it and clean those columns once more per
        filter, and the cleaning itself is compiled.
        """
        cleaned = [
            clean(F.col(raw_name + "_raw") if raw_name + "_raw" in raw.columns else F.lit(None).cast("string")).alias(name)
            for name, (raw_name, clean) in self.columns.items()
            if only is None or name in only
        ]
        number = F.col("row_id") + 0 * F.spark_partition_id()
        rows = raw.select(number.cast("bigint").alias("row_id"), *cleaned)
        # Up here a value is a plain column, so that a condition on it does not clean it again.
        limits = {c: F.when(keep(F.col(c)), F.col(c)) for c, keep in self.within.items() if c in rows.columns}
        return rows.withColumns(limits) if limits else rows

    def judged(self) -> list[str]:
        """The columns that decide whether a row is valid."""
        return [self.key, *self.required]

    def verdict(self) -> Column:
        return quality.all_present(self.required) & self.valid()

    def pick(self, typed: DataFrame, keep: str = "first") -> DataFrame:
        """The valid ones of typed rows, one per key."""
        valid, _ = quality.split_valid(typed, self.verdict())
        return keep_one(valid, [self.key], ["row_id"], keep)

    def clean(self, raw: DataFrame, keep: str = "first") -> DataFrame:
        return self.pick(self.typed(raw), keep)

    def rejects(self, raw: DataFrame) -> DataFrame:
        return quality.split_valid(self.typed(raw), self.verdict())[1]

    def accounting(self, raw: DataFrame) -> DataFrame:
        return self.counted(self.typed(raw, self.judged()))

    def counted(self, typed: DataFrame, picked: DataFrame | None = None) -> DataFrame:
        """The accounting of rows that are typed already, and of which ``picked`` may be written down."""
        if picked is not None:
            return quality.picked_accounting(typed, staging_name(self.source), self.verdict(), picked)
        return quality.row_accounting(typed, staging_name(self.source), self.verdict(), [self.key])


def _positive(c: Column) -> Column:
    return c >= 0


def _grade(c: Column) -> Column:
    return c.between(0, 10)


INTEGER, DECIMAL, TITLE, DATE = fn.clean_integer, fn.clean_decimal, fn.clean_title, fn.clean_date

ENTITIES = {
    "facultades": Entity(
        "facultad",
        "id_facultad",
        {
            "id_facultad": ("id_facultad", INTEGER),
            "nombre_facultad": ("nombre", TITLE),
            "ciudad_facultad": ("ciudad", TITLE),
            "provincia_facultad": ("provincia", TITLE),
        },
        ("id_facultad", "nombre_facultad"),
    ),
    "departamentos": Entity(
        "departamento",
        "id_departamento",
        {
            "id_departamento": ("id_departamento", INTEGER),
            "nombre_departamento": ("nombre", TITLE),
            "id_facultad": ("id_facultad", INTEGER),
        },
        ("id_departamento", "nombre_departamento"),
    ),
    "programas": Entity(
        "programa",
        "id_programa",
        {
            "id_programa": ("id_programa", INTEGER),
            "nombre_programa": ("nombre", TITLE),
            "tipo_programa": ("tipo", TITLE),
            "duracion_anios_programa": ("duracion_anios", INTEGER),
            "id_facultad": ("id_facultad", INTEGER),
        },
        ("id_programa", "nombre_programa"),
    ),
    "cursos": Entity(
        "curso",
        "id_curso",
        {
            "id_curso": ("id_curso", INTEGER),
            "codigo_curso": ("codigo", TITLE),
            "nombre_curso": ("nombre", TITLE),
            "horas_teo_curso": ("horas_teorica", INTEGER),
            "horas_prac_curso": ("horas_ejercicios", INTEGER),
            "horas_lab_curso": ("horas_laboratorio", INTEGER),
            "nivel_curso": ("nivel", INTEGER),
        },
        ("id_curso", "nombre_curso"),
        within={c: _positive for c in ("horas_teo_curso", "horas_prac_curso", "horas_lab_curso", "nivel_curso")},
    ),
    "docentes": Entity(
        "docente",
        "id_docente",
        {
            "id_docente": ("id_docente", INTEGER),
            "apellido_docente": ("apellido", TITLE),
            "nombre_docente": ("nombre", TITLE),
            "titulo_docente": ("titulo", TITLE),
            "categoria_docente": ("categoria", TITLE),
            "dedicacion_docente": ("dedicacion", TITLE),
            "id_departamento": ("id_departamento", INTEGER),
        },
        ("id_docente", "apellido_docente", "nombre_docente"),
    ),
    "estudiantes": Entity(
        "estudiante",
        "id_estudiante",
        {
            "id_estudiante": ("id_estudiante", INTEGER),
            "dni": ("dni", INTEGER),
            "apellido": ("apellido", TITLE),
            "nombre": ("nombre", TITLE),
            "genero": ("genero", fn.clean_gender),
            "fecha_nacimiento": ("fecha_nacimiento", DATE),
            "nacionalidad": ("nacionalidad", fn.clean_nationality),
            "id_programa": ("id_programa", INTEGER),
            "anio_ingreso": ("anio_ingreso", INTEGER),
        },
        ("id_estudiante", "dni", "apellido", "nombre", "id_programa"),
        lambda: fn.is_national_id(F.col("dni")),
    ),
    "dictados": Entity(
        "dictado",
        "id_dictado",
        {
            "id_dictado": ("id_dictado", INTEGER),
            "id_curso": ("id_curso", INTEGER),
            "id_docente": ("id_docente", INTEGER),
            "id_programa": ("id_programa", INTEGER),
            "periodo": ("periodo", TITLE),
            "turno": ("turno", TITLE),
            "aula": ("aula", TITLE),
            "cupo_maximo": ("cupo_maximo", INTEGER),
        },
        ("id_dictado", "id_curso", "id_docente"),
        within={"cupo_maximo": _positive},
    ),
    "inscripciones": Entity(
        "inscripcion",
        "id_inscripcion",
        {
            "id_inscripcion": ("id_inscripcion", INTEGER),
            "id_estudiante": ("id_estudiante", INTEGER),
            "id_dictado": ("id_dictado", INTEGER),
            "fecha_inscripcion": ("fecha_inscripcion", DATE),
            "estado": ("estado", TITLE),
        },
        ("id_inscripcion", "id_estudiante", "id_dictado", "fecha_inscripcion"),
    ),
    "examenes": Entity(
        "examen",
        "id_examen",
        {
            "id_examen": ("id_examen", INTEGER),
            "id_inscripcion": ("id_inscripcion", INTEGER),
            "fecha": ("fecha", DATE),
            "nota": ("nota", DECIMAL),
            "numero_intento": ("numero_intento", INTEGER),
            "resultado": ("resultado", TITLE),
        },
        ("id_examen", "id_inscripcion", "fecha", "nota", "numero_intento"),
        lambda: F.col("numero_intento") > 0,
        {"nota": _grade},
    ),
    "evaluaciones": Entity(
        "evaluacion_curso",
        "id_evaluacion",
        {
            "id_evaluacion": ("id_evaluacion", INTEGER),
            "id_dictado": ("id_dictado", INTEGER),
            "fecha_evaluacion": ("fecha_evaluacion", DATE),
            "puntaje_dictado": ("puntaje_dictado", DECIMAL),
            "puntaje_contenido": ("puntaje_contenido", DECIMAL),
            "valoracion_general": ("valoracion_general", DECIMAL),
        },
        ("id_evaluacion", "id_dictado", "fecha_evaluacion"),
    ),
}

CASCADE = CascadeColumns(
    person="id_estudiante", identity=("dni",), enrollment="id_inscripcion", offering="id_dictado"
)

# How each dimension reacts to changed attributes.
STUDENT_POLICY = ScdPolicy(
    natural="idalumno",
    surrogate="alumnoSKey",
    type2=("nombrePrograma", "tipoPrograma", "duracionAniosPrograma", "anioPlanPrograma"),
    type1=("genero", "egresoCarrera", "anioEgreso", "abandonoCarrera", "anioAbandono"),
)
OFFERING_POLICY = ScdPolicy(
    natural="idDictado",
    surrogate="dictadoSKey",
    type2=(
        "periodo", "turno", "horasTeoCurso", "horasPracCurso", "horasLabCurso", "nivelCurso", "nombreDocente",
        "apellidoDocente", "tituloDocente", "categoriaDocente", "dedicacionDocente",
    ),
    type1=("aula", "cupoMax", "nombreCurso"),
)


def dimension_columns(table: str) -> list[str]:
    """The columns of a dimension without its surrogate key."""
    return StructType.fromDDL(WAREHOUSE_SCHEMAS[table]).names[1:]


def student_dimension(students: DataFrame, programs: DataFrame, as_of: dt.date) -> DataFrame:
    """Students with their programme and their age at entry, plus ``row_id``."""
    joined = skew_safe_join(students, programs.drop("row_id"), ["id_programa"])
    named = joined.withColumnsRenamed(
        {
            "id_estudiante": "idalumno",
            "fecha_nacimiento": "fechaNacim",
            "anio_ingreso": "anioIngreso",
            "nombre_programa": "nombrePrograma",
            "tipo_programa": "tipoPrograma",
            "duracion_anios_programa": "duracionAniosPrograma",
        }
    )
    unknown_year = F.lit(None).cast("int")
    full = dimensions.versioned(
        named,
        as_of,
        edadIngreso=fn.age_at(F.col("fechaNacim"), F.col("anioIngreso")),
        egresoCarrera=F.lit(False),
        anioEgreso=unknown_year,
        abandonoCarrera=F.lit(False),
        anioAbandono=unknown_year,
        anioPlanPrograma=unknown_year,
    )
    return full.select("row_id", *dimension_columns("dim_estudiante"))


def offering_parents(lookups: Mapping[str, DataFrame]) -> list[tuple[DataFrame, str]]:
    """The chain from an offering up to its faculty."""
    steps = [("cursos", "id_curso"), ("docentes", "id_docente"), ("departamentos", "id_departamento"), ("facultades", "id_facultad")]
    return [(lookups[name].drop("row_id"), key) for name, key in steps]


def offering_dimension(offerings: DataFrame, lookups: Mapping[str, DataFrame], as_of: dt.date) -> DataFrame:
    """Offerings with course, teacher, department and faculty, plus ``row_id``."""
    named = flatten_chain(offerings, offering_parents(lookups)).withColumnsRenamed(
        {
            "id_dictado": "idDictado",
            "cupo_maximo": "cupoMax",
            "codigo_curso": "codigoCurso",
            "nombre_curso": "nombreCurso",
            "horas_teo_curso": "horasTeoCurso",
            "horas_prac_curso": "horasPracCurso",
            "horas_lab_curso": "horasLabCurso",
            "nivel_curso": "nivelCurso",
            "nombre_docente": "nombreDocente",
            "apellido_docente": "apellidoDocente",
            "titulo_docente": "tituloDocente",
            "categoria_docente": "categoriaDocente",
            "dedicacion_docente": "dedicacionDocente",
            "nombre_departamento": "nombreDep",
            "nombre_facultad": "nombreFac",
            "ciudad_facultad": "ciudadFac",
            "provincia_facultad": "provFac",
        }
    )
    return dimensions.versioned(named, as_of).select("row_id", *dimension_columns("dim_dictado"))


def dates_of(enrollments: DataFrame, exams: DataFrame, evaluations: DataFrame) -> DataFrame:
    return dimensions.distinct_dates(
        (enrollments, "fecha_inscripcion"), (exams, "fecha"), (evaluations, "fecha_evaluacion")
    )


# Fixed value: days from an enrollment to its evaluation where the offering has no calendar.
DAYS_TO_EVALUATION = 90


def evaluations_in_turn(evaluations: DataFrame, enrollments: DataFrame, calendar: DataFrame) -> DataFrame:
    """Anonymous evaluations with a student each, by the documented rule.

    The evaluations of an offering go to its enrollments in turn, both in the order of their ids,
    over again if there are more evaluations. The date is that of the offering's ``calendar``
    (``id_dictado``, ``fecha_evaluacion``), else the enrollment's date plus 90 days. Evaluations of
    offerings without enrollments keep a null student and are not ``asignada``.
    """
    holders = enrollments.select("id_dictado", "id_inscripcion", "id_estudiante", "fecha_inscripcion")
    anonymous = evaluations.drop("fecha_evaluacion", *[c for c in holders.columns if c != "id_dictado"])
    given = assign_in_turn(anonymous, holders, ["id_dictado"], "id_evaluacion", "id_inscripcion")
    dated = skew_safe_join(given, calendar.select("id_dictado", F.col("fecha_evaluacion").cast("date").alias("fecha_evaluacion")), ["id_dictado"])
    late = F.date_add("fecha_inscripcion", DAYS_TO_EVALUATION)
    assigned = F.col("id_inscripcion").isNotNull()
    return dated.withColumns({"fecha_evaluacion": F.when(assigned, F.coalesce("fecha_evaluacion", late)), "asignada": assigned})


def student_references(students: DataFrame, programmes: DataFrame) -> DataFrame:
    """Students whose programme is unknown, as a row of branch and count."""
    joined = skew_safe_join(students.drop("row_id"), programmes.drop("row_id"), ["id_programa"])
    return missing_references(joined, {"programa": "nombre_programa"})


def offering_references(offerings: DataFrame, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Offerings without course, teacher, department or faculty: a row of branch and count for each."""
    joined = flatten_chain(offerings.drop("row_id"), offering_parents(parents))
    branches = {
        "curso": "nombre_curso", "docente": "nombre_docente", "departamento": "nombre_departamento", "facultad": "nombre_facultad",
    }
    return missing_references(joined, branches)


def student_keys(dim_estudiante: DataFrame) -> facts.KeyLookup:
    return facts.KeyLookup("id_estudiante", current_key_map(dim_estudiante, "idalumno", "alumnoSKey"), "idalumno", "alumnoSKey")


def offering_keys(dim_dictado: DataFrame) -> facts.KeyLookup:
    return facts.KeyLookup("id_dictado", current_key_map(dim_dictado, "idDictado", "dictadoSKey"), "idDictado", "dictadoSKey")


def with_passed(exams: DataFrame) -> DataFrame:
    return exams.withColumn("aprobado", fn.matches_any(F.col("resultado"), PASSED_RESULT))


# What the attempt rules need of an exam, and what its fact needs once the keys are found.
EXAM_COLUMNS = ["id_examen", "id_inscripcion", "fecha", "nota", "numero_intento", "aprobado"]
KEYED_EXAM_COLUMNS = ["id_examen", "fecha", "nota", "numero_intento", "aprobado", "alumnoSKey", "dictadoSKey"]


def judged_exams(exams: DataFrame) -> DataFrame:
    """Exams by the columns that later steps read, as they move and are written several times."""
    return with_passed(exams).select(EXAM_COLUMNS)


def keyed_exams(exams: DataFrame, enrollments: DataFrame, lookups: Sequence[facts.KeyLookup]) -> DataFrame:
    """Exams with the surrogate keys of their enrollment's student and offering, null when unknown."""
    return facts.resolve_keys(own_exams(exams, enrollments), lookups).select(KEYED_EXAM_COLUMNS)


def enrollment_fact(enrollments: DataFrame, students: facts.KeyLookup, offerings: facts.KeyLookup) -> DataFrame:
    """One row per student and offering, the last enrollment winning.

    The date key is computed, not looked up: the calendar holds every date used.
    """
    resolved = facts.resolve_keys(
        enrollments.withColumn("tiempoSKey", fn.date_key(F.col("fecha_inscripcion"))), [students, offerings]
    )
    found = facts.with_all_keys(resolved, ["alumnoSKey", "dictadoSKey", "tiempoSKey"])
    last = keep_one(found, FACT_KEYS["fact_inscripcion"], ["row_id"], keep="last")
    return last.select(
        "alumnoSKey", "tiempoSKey", "dictadoSKey", "estado", fn.matches_any(F.col("estado"), *DROPOUT_STATES).alias("abandono")
    )


def own_exams(exams: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Exams with the student and offering of their enrollment, null when it is unknown."""
    return skew_safe_join(exams, enrollments.select("id_inscripcion", "id_estudiante", "id_dictado"), ["id_inscripcion"])


def exam_fact(owned: DataFrame) -> DataFrame:
    """One row per student, offering and attempt, the latest exam winning.

    ``owned`` carries the surrogate keys of student and offering.
    """
    keyed = owned.withColumn("tiempoSKey", fn.date_key(F.col("fecha"))).withColumnRenamed("numero_intento", "nroIntentos")
    found = facts.with_all_keys(keyed, ["alumnoSKey", "dictadoSKey", "tiempoSKey"])
    last = keep_one(found, FACT_KEYS["fact_examen_estudiante"], ["fecha", "id_examen"], keep="last")
    return last.select("alumnoSKey", "tiempoSKey", "dictadoSKey", "nota", "nroIntentos", "aprobado")


def evaluation_fact(evaluations: DataFrame, offerings: facts.KeyLookup, once_per: Sequence[str] = ()) -> DataFrame:
    """One row per evaluation; equal rows are different anonymous answers.

    With ``once_per`` (such as ``dictadoSKey``, ``tiempoSKey``) the first evaluation
    per combination of these columns is kept, for sources that repeat answers.
    """
    resolved = facts.resolve_keys(
        evaluations.withColumn("tiempoSKey", fn.date_key(F.col("fecha_evaluacion"))), [offerings]
    )
    found = facts.with_all_keys(resolved, ["dictadoSKey", "tiempoSKey"])
    if once_per:
        found = keep_one(found, once_per, ["id_evaluacion"])
    return found.select(
        "dictadoSKey",
        "tiempoSKey",
        F.col("puntaje_dictado").alias("notaDictado"),
        F.col("puntaje_contenido").alias("notaCont"),
        F.col("valoracion_general").alias("notaGeneral"),
    )
