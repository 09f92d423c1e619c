"""Both pipelines end to end on a small dirty university."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import brute
from fixtures import _row, make_rows, write_sources
from starloom.operators import quality
from starloom.operators.keys import assign_keys_in_place, next_key
from starloom.plans import university as u
from starloom.plans.incremental import read_deltas, run_incremental
from starloom.plans.initial_load import (
    ENROLLMENT_MAP,
    STUDENT_MAP,
    MissingSources,
    load_staging,
    load_warehouse,
    open_staging,
    open_warehouse,
)
from starloom.sources.audit import AuditLog
from starloom.sources.staging import blank_null_tokens, stage, text_schema

AS_OF = dt.date(2025, 1, 1)
BEGAN = dt.datetime(2025, 1, 1, 10)
ROWS = make_rows()
# The incremental scenario needs a student 1 in programme 3 whose national id is his alone.
ROWS["estudiante"][0] = _row(
    "estudiante", 1, "34157347", "Flores", "Agustín", "M", "2004-04-01", "", "", "Argentina", 3, 2020
)


class World:
    def __init__(self, spark, folder):
        self.spark = spark
        self.staging = open_staging(spark, f"{folder}/staging")
        self.warehouse = open_warehouse(spark, f"{folder}/warehouse")
        self.audit = AuditLog(spark, f"{folder}/audit")

    def rows(self, table, *columns):
        return sorted(tuple(r) for r in self.warehouse.read(table).select(*columns).collect())

    def facts(self, table, *columns):
        """A fact with natural keys instead of surrogate ones."""
        fact = self.warehouse.read(table)
        offerings = self.warehouse.read("dim_dictado").select("dictadoSKey", "idDictado")
        fact = fact.join(offerings, "dictadoSKey")
        if "alumnoSKey" in fact.columns:
            fact = fact.join(self.warehouse.read("dim_estudiante").select("alumnoSKey", "idalumno"), "alumnoSKey")
        return sorted(tuple(r) for r in fact.select(*columns).collect())

    def add(self, source, loaded_at, *rows, extra=None):
        """Stage rows as a later delivery."""
        columns = list(u.SOURCE_COLUMNS[source]) + ([extra] if extra else [])
        df = blank_null_tokens(self.spark.createDataFrame(rows, text_schema(columns)))
        table = u.staging_name(source)
        start = next_key(self.staging.read(table), "row_id")
        self.staging.append(table, stage(assign_keys_in_place(df.coalesce(1), "row_id", start), "delta", F.lit(loaded_at)))
        self.staging.publish()


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("university")
    write_sources(folder / "sources", ROWS)
    world = World(spark, folder)
    world.sources = str(folder / "sources")
    world.sizes = load_staging(world.staging, world.sources, BEGAN - dt.timedelta(hours=1), AS_OF)
    world.report = load_warehouse(world.staging, world.warehouse, world.audit, AS_OF, BEGAN)
    world.expected = brute.full_load(ROWS, AS_OF)
    return world


def text(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def test_staging(world):
    assert {r.tabla: r.filas for r in world.sizes.collect()} == {u.staging_name(s): len(r) for s, r in ROWS.items()}
    staged = world.staging.read("stg_estudiante").orderBy("row_id").collect()
    assert [r.row_id for r in staged] == list(range(1, len(ROWS["estudiante"]) + 1))
    assert [r.id_estudiante_raw for r in staged] == [row[0] for row in ROWS["estudiante"]]
    assert {r.archivo_origen for r in staged} == {"estudiante.csv"}
    assert {r.nacionalidad_raw for r in staged} == {"Argentina", None}


def test_maps(world):
    for table, expected in zip((STUDENT_MAP, ENROLLMENT_MAP), world.expected["maps"]):
        assert {r.id_repetido: r.id_tomado for r in world.staging.read(table).collect()} == expected


def test_dimensions(world):
    assert [r[0] for r in world.rows("dim_tiempo", "tiempoSKey")] == world.expected["dim_tiempo"]
    students = world.rows(
        "dim_estudiante", "idalumno", "dni", "nombre", text("genero"), F.coalesce(text("fechaNacim"), F.lit("")),
        "nacionalidad", F.coalesce("anioIngreso", F.lit(0)), F.coalesce("edadIngreso", F.lit(-1)), text("nombrePrograma"),
    )
    assert [tuple("None" if i == 4 and v == "" else v for i, v in enumerate(s)) for s in students] == world.expected["dim_estudiante"]
    columns = [
        "idDictado", "periodo", "turno", "aula", "cupoMax", "codigoCurso", "nombreCurso", "horasTeoCurso",
        "dedicacionDocente", "nombreDep", "nombreFac", "provFac",
    ]
    assert world.rows("dim_dictado", *[text(c) for c in columns]) == world.expected["dim_dictado"]


def test_surrogate_keys(world):
    students = world.warehouse.read("dim_estudiante").orderBy("dni", "idalumno").collect()
    assert [r.alumnoSKey for r in students] == list(range(1, len(students) + 1))
    offerings = world.warehouse.read("dim_dictado").orderBy("idDictado").collect()
    assert [r.dictadoSKey for r in offerings] == list(range(1, len(offerings) + 1))
    for table, surrogate in u.FACT_SURROGATES.items():
        numbers = sorted(r[0] for r in world.warehouse.read(table).select(surrogate).collect())
        assert numbers == list(range(1, len(numbers) + 1))


def test_facts(world):
    assert world.facts("fact_inscripcion", "idalumno", "idDictado", "tiempoSKey", text("estado"), "abandono") == world.expected["fact_inscripcion"]
    exams = world.facts("fact_examen_estudiante", "idalumno", "idDictado", "nroIntentos", "tiempoSKey", F.col("nota").cast("double"), "aprobado")
    assert exams == world.expected["fact_examen_estudiante"]
    scores = [F.col(c).cast("double") for c in ("notaDictado", "notaGeneral")]
    assert world.facts("fact_evaluacion_dictado", "idDictado", "tiempoSKey", *scores) == world.expected["fact_evaluacion_dictado"]


def test_constraints(world):
    students, offerings = world.warehouse.read("dim_estudiante"), world.warehouse.read("dim_dictado")
    for table, unique in u.FACT_KEYS.items():
        fact = world.warehouse.read(table)
        assert quality.orphans(fact, "dictadoSKey", offerings, "dictadoSKey").isEmpty()
        assert quality.orphans(fact, "tiempoSKey", world.warehouse.read("dim_tiempo"), "tiempoSKey").isEmpty()
        assert not unique or quality.repeated_keys(fact, unique).isEmpty()
    assert quality.not_one_current(students, "idalumno").isEmpty()
    assert quality.bad_intervals(students).isEmpty()
    long = quality.too_long(offerings, u.TEXT_LIMITS["dim_dictado"]).select("column", "length").distinct().collect()
    assert [(r.column, r.length) for r in long] == [("periodo", 5)]


def test_reports(world):
    cleaning = {r.tabla: r for r in world.report.cleaning.collect()}
    assert cleaning["stg_estudiante"].duplicados == 1
    assert cleaning["stg_inscripcion"].rechazados == 14
    counters = {r.contador: r.valor for r in world.report.duplicates.collect()}
    student_map, enrollment_map = world.expected["maps"]
    assert counters["estudiantes_duplicados"] == len(student_map)
    assert counters["inscripciones_duplicadas"] == len(enrollment_map)
    tables = {r.tabla: r for r in world.report.tables.collect()}
    assert all(r.validos == r.final for r in tables.values())
    assert tables["fact_inscripcion"].final == len(world.expected["fact_inscripcion"])
    missing = {r.branch: r.missing_rows for r in world.report.references.collect()}
    names = [r.nombreCurso for r in world.warehouse.read("dim_dictado").collect()]
    assert missing["curso"] == names.count(None)


def test_every_extract_is_read_once(world, tmp_path, monkeypatch):
    """The calendar of evaluations comes from the offerings that are staged beside them."""
    from starloom.plans import initial_load

    read, plain = [], initial_load.read_source

    def counted(spark, folder, source, multi_line=False):
        read.append(source)
        return plain(spark, folder, source, multi_line)

    monkeypatch.setattr(initial_load, "read_source", counted)
    other = World(world.spark, tmp_path)
    load_staging(other.staging, world.sources, BEGAN - dt.timedelta(hours=1), AS_OF)
    assert sorted(read) == sorted(u.SOURCE_COLUMNS)
    dated = [sorted(tuple(r) for r in w.staging.read("stg_evaluacion_curso").select("row_id", "id_dictado_raw", "fecha_evaluacion_raw").collect()) for w in (world, other)]
    assert dated[0] == dated[1] and len({r[2] for r in dated[0]}) > 1


def test_exams_move_with_the_columns_that_are_read(world):
    """Neither the result's text nor the order number follows an exam once it is judged."""
    clean = {name: u.ENTITIES[name].clean(world.staging.read(u.staging_name(u.ENTITIES[name].source))) for name in ("examenes", "inscripciones")}
    keys = [u.student_keys(world.warehouse.read("dim_estudiante")), u.offering_keys(world.warehouse.read("dim_dictado"))]
    judged = u.judged_exams(clean["examenes"])
    keyed = u.keyed_exams(judged, clean["inscripciones"], keys)
    assert not {"resultado", "row_id"} & {*judged.columns, *keyed.columns} and "id_estudiante" not in keyed.columns
    assert keyed.count() == clean["examenes"].count()


def test_missing_source(world, tmp_path):
    rows = {s: r for s, r in ROWS.items() if s != "examen"}
    write_sources(tmp_path / "partial", rows)
    with pytest.raises(MissingSources, match="examen.csv"):
        load_staging(world.staging, str(tmp_path / "partial"), BEGAN, AS_OF)
    assert world.staging.read("stg_examen").count() == len(ROWS["examen"])


def deliver_scenario(world, when):
    world.add(
        "estudiante", when,
        _row("estudiante", 9000001, 91111111, "Pérez", "Juan Manuel", "M", "2001-03-15", "", "", "Argentina", 6, 2025),
        _row("estudiante", 9000002, 91111111, "Perez", "Juan M.", "M", "2001-03-15", "", "", "Argentina", 6, 2025),
        _row("estudiante", 1, 34157347, "Flores", "Agustín", "M", "2004-04-01", "", "", "Argentina", 7, 2020),
        _row("estudiante", 9000003, 91333444, "López", "María Sol", "F", "2002-11-08", "", "", "Argentina", 6, 2025),
    )
    world.add("dictado", when, _row("dictado", 9999990, 1, 1, 6, 2026, "C1", "Mañana", "LAB-A1", 60))
    world.add(
        "inscripcion", when,
        _row("inscripcion", 9900001, 9000001, 9999990, "2026-03-10", "Activa"),
        _row("inscripcion", 9900002, 9000002, 9999990, "2026-03-12", "Activa"),
        _row("inscripcion", 9900003, 9000003, 9999990, "2026-03-11", "Activa"),
    )
    world.add(
        "examen", when,
        _row("examen", 9800001, 9900001, "2026-07-10", "3.50", 1, "Desaprobado"),
        _row("examen", 9800002, 9900001, "2026-07-24", "7.00", 2, "Aprobado"),
        _row("examen", 9800003, 9900002, "2026-08-05", "2.00", 1, "Desaprobado"),
        _row("examen", 9800004, 9900002, "2026-08-20", "5.50", 2, "Desaprobado"),
        _row("examen", 9800005, 9900003, "2026-07-10", "8.50", 1, "Aprobado"),
    )
    world.add(
        "evaluacion_curso", when,
        [*_row("evaluacion_curso", 9990001, 9999990, "8.5", "9.0", "8.75"), "2026-07-20"],
        [*_row("evaluacion_curso", 9990002, 9999990, "7.0", "7.5", "7.25"), "2026-07-20"],
        extra="fecha_evaluacion",
    )


def test_incremental_scenario(world):
    """The ten published scenarios, a quiet run, a repeat, and later corrections."""
    before = {t: world.warehouse.read(t).count() for t in world.warehouse.schemas}
    deliver_scenario(world, dt.datetime(2026, 9, 1, 8))
    report = run_incremental(world.staging, world.warehouse, world.audit, dt.datetime(2026, 9, 1, 9), dt.date(2026, 9, 1))

    assert report.delta_rows == 15
    assert report.students == {"insertados": 3, "actualizados_scd2": 1, "actualizados_scd1": 0, "sin_cambios": 0}
    assert report.offerings == {"insertados": 1, "actualizados_scd2": 0, "actualizados_scd1": 0, "sin_cambios": 0}
    assert report.facts == {
        "fact_inscripcion": {"insertados": 2, "actualizados": 0},
        "fact_examen_estudiante": {"insertados": 3, "actualizados": 0},
        "fact_evaluacion_dictado": {"insertados": 2, "actualizados": 0},
    }
    added = {t: world.warehouse.read(t).count() - before[t] for t in before}
    assert added == {
        "dim_tiempo": report.new_dates, "dim_dictado": 1, "dim_estudiante": 3, "fact_examen_estudiante": 3,
        "fact_evaluacion_dictado": 2, "fact_inscripcion": 2,
    }
    students = world.warehouse.read("dim_estudiante")
    versions = students.where("idalumno = 1").orderBy("alumnoSKey").collect()
    assert [(v.nombrePrograma, v.es_actual, v.valid_to) for v in versions] == [
        ("Ingeniería 3", False, dt.date(2026, 9, 1)), ("Ingeniería 7", True, None),
    ]
    assert students.where("idalumno = 9000002").isEmpty()
    assert quality.repeated_keys(students, ["alumnoSKey"]).isEmpty()
    assert quality.not_one_current(students, "idalumno").isEmpty()
    exams = [r for r in world.facts("fact_examen_estudiante", "idalumno", "nroIntentos", F.col("nota").cast("double"), "aprobado", "idDictado") if r[4] == 9999990]
    assert [r[:4] for r in exams] == [(9000001, 1, 3.5, False), (9000001, 2, 7.0, True), (9000003, 1, 8.5, True)]
    assert {r.id_repetido: r.id_tomado for r in world.staging.read(STUDENT_MAP).collect()}[9000002] == 9000001
    assert {r.id_repetido: r.id_tomado for r in world.staging.read(ENROLLMENT_MAP).collect()}[9900002] == 9900001

    # Nothing new: nothing happens, and the watermark moves on.
    state = {t: world.warehouse.read(t).count() for t in before}
    assert run_incremental(world.staging, world.warehouse, world.audit, dt.datetime(2026, 9, 1, 10)).delta_rows == 0
    assert world.audit.last_watermark() == dt.datetime(2026, 9, 1, 10)

    # The same rows again change nothing but the anonymous evaluations.
    deliver_scenario(world, dt.datetime(2026, 9, 1, 11))
    again = run_incremental(world.staging, world.warehouse, world.audit, dt.datetime(2026, 9, 1, 12), dt.date(2026, 9, 1))
    assert again.students["sin_cambios"] == 3 and again.students["insertados"] == 0
    assert again.facts["fact_inscripcion"] == {"insertados": 0, "actualizados": 2}
    assert again.facts["fact_examen_estudiante"] == {"insertados": 0, "actualizados": 0}
    grown = {t: world.warehouse.read(t).count() - state[t] for t in before}
    assert grown["fact_evaluacion_dictado"] == 2
    assert grown["dim_estudiante"] == grown["dim_dictado"] == grown["fact_inscripcion"] == grown["dim_tiempo"] == 0

    # A changed state updates the stored enrollment and keeps its date; a changed room is type 1.
    later = dt.datetime(2026, 9, 2, 8)
    world.add("inscripcion", later, _row("inscripcion", 9900003, 9000003, 9999990, "2026-05-05", "Baja"))
    world.add("dictado", later, _row("dictado", 9999990, 1, 1, 6, 2026, "C1", "Mañana", "LAB-B2", 60))
    world.add("examen", later, _row("examen", 9800006, 9900003, "2026-09-01", "9", 1, "Aprobado"))
    change = run_incremental(world.staging, world.warehouse, world.audit, dt.datetime(2026, 9, 2, 9), dt.date(2026, 9, 2))
    assert change.offerings["actualizados_scd1"] == 1
    assert change.facts["fact_inscripcion"] == {"insertados": 0, "actualizados": 1}
    assert change.facts["fact_examen_estudiante"]["insertados"] == 0
    stored = [r for r in world.facts("fact_inscripcion", "idalumno", "idDictado", "tiempoSKey", "estado", "abandono") if r[:2] == (9000003, 9999990)]
    assert stored == [(9000003, 9999990, 20260311, "Baja", True)]
    room = world.warehouse.read("dim_dictado").where("idDictado = 9999990").collect()
    assert [(r.aula, r.es_actual) for r in room] == [("Lab-B2", True)]


def test_failed_run(world, monkeypatch):
    """A failure publishes nothing, is logged, and leaves the watermark."""
    from starloom.plans import incremental

    mark = world.audit.last_watermark()
    counts = {t: world.warehouse.read(t).count() for t in world.warehouse.schemas}
    world.add("estudiante", dt.datetime(2026, 9, 3, 8), _row("estudiante", 9000009, 95555555, "A", "B", "F", "2000", "", "", "", 6, 2025))

    def fail(*_args, **_kwargs):
        raise RuntimeError("no space")

    monkeypatch.setattr(incremental, "close_deleted", fail)
    with pytest.raises(RuntimeError, match="no space"):
        run_incremental(world.staging, world.warehouse, world.audit, dt.datetime(2026, 9, 3, 9))
    monkeypatch.undo()
    assert {t: world.warehouse.read(t).count() for t in counts} == counts
    assert world.audit.last_watermark() == mark
    last = world.audit.runs().orderBy(F.desc("id")).first()
    assert (last.estado, last.mensaje_error) == ("ERROR", "no space")
    retry = run_incremental(world.staging, world.warehouse, world.audit, dt.datetime(2026, 9, 3, 10))
    assert retry.students["insertados"] == 1


def test_rows_staged_during_a_run_arrive_in_the_next(world, monkeypatch):
    """The delta is chosen by staging version, so a clock cannot skip rows."""
    from starloom.plans import incremental

    world.add("estudiante", dt.datetime(2026, 9, 4, 8), _row("estudiante", 9000010, 96666661, "A", "B", "F", "2000", "", "", "", 6, 2025))
    apply = incremental.apply_deltas

    def staged_meanwhile(*args, **kwargs):
        other = World(world.spark, world.staging.root.removesuffix("/staging"))
        # Loaded at a moment before the watermark that this run will leave.
        other.add("estudiante", dt.datetime(2026, 9, 4, 8, 30), _row("estudiante", 9000011, 96666662, "A", "B", "F", "2000", "", "", "", 6, 2025))
        return apply(*args, **kwargs)

    monkeypatch.setattr(incremental, "apply_deltas", staged_meanwhile)
    first = run_incremental(world.staging, world.warehouse, world.audit, dt.datetime(2026, 9, 4, 9), dt.date(2026, 9, 4))
    monkeypatch.undo()
    second = run_incremental(world.staging, world.warehouse, world.audit, dt.datetime(2026, 9, 4, 10), dt.date(2026, 9, 4))
    third = run_incremental(world.staging, world.warehouse, world.audit, dt.datetime(2026, 9, 4, 11), dt.date(2026, 9, 4))
    assert (first.delta_rows, second.delta_rows, third.delta_rows) == (1, 1, 0)
    current = world.warehouse.read("dim_estudiante").where("idalumno in (9000010, 9000011)")
    assert current.count() == 2


def test_first_run_without_a_log_reads_everything(world, tmp_path):
    """No row is left out for want of a watermark."""
    empty = World(world.spark, tmp_path)
    report = run_incremental(world.staging, empty.warehouse, empty.audit, dt.datetime(2026, 9, 5, 9), dt.date(2026, 9, 5))
    staged = sum(world.staging.read(u.staging_name(e.source)).count() for e in u.ENTITIES.values())
    assert report.delta_rows == staged > 0


def test_cleaning_is_compiled_and_done_once(spark):
    """No generator (worked out row by row without compiled code), and no filter below the cleaning."""
    entity = u.ENTITIES["examenes"]
    raw = spark.createDataFrame(
        [(1, "10", "1", "30-07-2020", "7,5", "1", "APROBADO"), (2, "11", "1", "30-07-2020", "10,5", "2", None), (3, "12", "1", "s/d", "5", "1", None)],
        "row_id bigint, " + ", ".join(f"{c}_raw string" for c in u.SOURCE_COLUMNS["examen"]),
    )
    picked = entity.typed(raw).where(entity.verdict())
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    cleaned = plan.split("Project [")[-1]
    assert "Generate" not in plan and "nota_raw" not in plan.split("Filter")[1].split("\n")[0] and "nota_raw" in cleaned
    assert [(r.row_id, r.nota) for r in entity.typed(raw).orderBy("row_id").collect()] == [(1, 7.5), (2, None), (3, 5.0)]
    assert [tuple(r) for r in picked.select("row_id", "id_examen", "fecha", "resultado").collect()] == [(1, 10, dt.date(2020, 7, 30), "Aprobado")]


def test_a_delta_is_read_from_staging_and_not_copied(world):
    deltas, _ = read_deltas(world.staging, None, 0)
    assert all(f"{world.staging.root}/stg_" in file for df in deltas.values() for file in df.inputFiles())
    assert deltas["examenes"].count() == world.staging.read("stg_examen").count()
