"""State that deltas are merged into: duplicate maps, buckets of dimensions and facts, snapshots, moved identities."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fixtures import _row, make_rows, write_sources
from starloom.operators import groups, repoint, snapshot
from starloom.plans import duplicate_maps as maps
from starloom.plans import university as u
from starloom.plans.incremental import merge_dimension, run_incremental
from starloom.plans.initial_load import BUCKETS, open_warehouse, run_full_load
from starloom.sources.store import ConflictingWriter, TableStore, bucket
from test_university import World

STUDENTS, ENROLLMENTS = u.staging_name("estudiante"), u.staging_name("inscripcion")


def plain_maps(students, enrollments):
    """The maps of everything staged: smallest id of each group, smallest canonical id of each id."""

    def smallest(pairs):
        members, found = defaultdict(set), {}
        for key, i in pairs:
            members[key].add(i)
        for ids in members.values():
            for i in ids - {min(ids)}:
                found[i] = min(min(ids), found.get(i, min(ids)))
        return found

    people = smallest([(dni, i) for i, dni in students if dni is not None and 1_000_000 <= dni <= 99_999_999])
    return people, smallest([((people.get(p, p), d), e) for e, p, d in enrollments])


def stage_rows(world, students, enrollments, when):
    if students:
        world.add("estudiante", when, *[_row("estudiante", i, dni, "A", "B", "F", "2000", "", "", "", 1, 2020) for i, dni in students])
    if enrollments:
        world.add("inscripcion", when, *[_row("inscripcion", e, p, d, "2024-03-01", "activa") for e, p, d in enrollments])


def stored(staging):
    return tuple({r.id_repetido: r.id_tomado for r in staging.read(t).collect()} for t in (maps.STUDENT_MAP, maps.ENROLLMENT_MAP))


def refresh(staging, since):
    staging.discard()
    with staging.transaction():
        seen = staging.version()
        deltas = {
            "estudiantes": staging.read_since(STUDENTS, since),
            "inscripciones": staging.read_since(ENROLLMENTS, since),
        }
        found = maps.refresh_maps(staging, deltas, since, seen)
        changes = [{(r.id, r.antes, r.despues) for r in c.collect()} for c in (found.student_changes, found.enrollment_changes)]
    staging.discard()
    return seen, found.rebuilt, changes


def test_maps_of_random_deltas_equal_a_rebuild(spark, tmp_path):
    """Ids that change their group, chains, smaller ids that come later, repeated deliveries."""
    rng = random.Random(4)
    world = World(spark, tmp_path)
    students, enrollments, since, before = [], [], None, ({}, {})
    for turn in range(5):
        new = [(rng.randint(1, 30), rng.choice([None, 5, *[40_000_000 + k for k in range(9)]])) for _ in range(12 if turn else 25)]
        owned = [(rng.randint(1, 60), rng.randint(1, 32), rng.randint(1, 4)) for _ in range(10 if turn else 40)]
        if turn == 3:
            new = []
        stage_rows(world, new, owned, dt.datetime(2024, 1, 1 + turn))
        students, enrollments = students + new, enrollments + owned
        since, rebuilt, changes = refresh(world.staging, since)
        assert rebuilt == (turn == 0)
        after = plain_maps(students, enrollments)
        assert stored(world.staging) == after
        for old, now, found in zip(before, after, changes, strict=True):
            assert found == {(i, old.get(i, i), now.get(i, i)) for i in {*old, *now} if old.get(i, i) != now.get(i, i)}
        before = after
    # A repeated delta changes nothing, and a replaced staging table is read anew.
    assert refresh(world.staging, 0)[1:] == (False, [set(), set()])
    with world.staging.transaction():
        world.staging.replace(STUDENTS, world.staging.read(STUDENTS).where("id_estudiante_raw <> '7'"))
    _, rebuilt, _ = refresh(world.staging, since)
    assert rebuilt and stored(world.staging) == plain_maps([s for s in students if s[0] != 7], enrollments)


def test_a_delta_rewrites_touched_buckets_only(spark, tmp_path):
    world = World(spark, tmp_path)
    stage_rows(world, [(i, 40_000_000 + i // 2) for i in range(1, 200)], [(i, i, 1) for i in range(1, 200)], dt.datetime(2024, 1, 1))
    since, _, _ = refresh(world.staging, None)
    before = {t: set(world.staging._folders(t)) for t in maps.BUCKET_KEYS}
    stage_rows(world, [(500, 40_000_010)], [], dt.datetime(2024, 1, 2))
    refresh(world.staging, since)
    after = {t: set(world.staging._folders(t)) for t in maps.BUCKET_KEYS}
    assert all(len(before[t]) == BUCKETS for t in (maps.STUDENT_PAIRS, maps.STUDENT_MAP))
    assert len(after[maps.STUDENT_PAIRS] - before[maps.STUDENT_PAIRS]) == 1 and before[maps.STUDENT_PAIRS] <= after[maps.STUDENT_PAIRS]
    for table in (maps.STUDENT_GROUPS, maps.STUDENT_MAP):
        assert len(before[table] - after[table]) == len(after[table] - before[table]) == 1
    assert after[maps.ENROLLMENT_MAP] == before[maps.ENROLLMENT_MAP]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id_repetido bigint, id_tomado bigint")


def test_chains(spark):
    chain = [(i + 1, i) for i in range(1, 40)] + [(100, 3), (None, 1), (101, None), (102, 50)]
    found = {r.id_repetido: r.id_tomado for r in groups.compact_chains(pairs(spark, chain)).collect()}
    assert found == {**{i: 1 for i in range(2, 41)}, 100: 1, 102: 50}
    assert groups.compact_chains(pairs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="smaller"):
        groups.compact_chains(pairs(spark, [(3, 5), (5, 3)]))
    changed = spark.createDataFrame([(9, 9, 8), (70, 70, 60)], "id bigint, antes bigint, despues bigint")
    followed = repoint.follow_chains(changed, pairs(spark, chain)).collect()
    assert {(r.id, r.antes, r.despues) for r in followed} == {(9, 9, 1), (70, 70, 60)}


def test_snapshot_changes(spark):
    schema = "k int, a string, b int"
    old = spark.createDataFrame([(1, "x", 1), (2, "x", None), (3, "", 1), (4, "t", 1), (4, "t", 1), (5, "p", 1), (5, "q", 1), (None, "z", 1)], schema)
    new = spark.createDataFrame([(1, "x", 1), (2, "x", 0), (3, None, 1), (4, "t", 1), (5, "q", 1), (5, "p", 1), (6, "n", 1), (None, "y", 1)], schema)
    found = {r.k: r.cambio for r in snapshot.snapshot_changes(old, new, ["k"], ["a", "b"]).collect()}
    assert found == {1: snapshot.SAME, 2: snapshot.CHANGED, 3: snapshot.CHANGED, 4: snapshot.SAME, 5: snapshot.SAME, 6: snapshot.INSERTED}
    assert {r.k: r.cambio for r in snapshot.snapshot_changes(old, new.limit(0), ["k"], ["a"]).collect()} == {k: snapshot.DELETED for k in (1, 2, 3, 4, 5)}


def test_buckets_and_numbers_of_a_store(spark, tmp_path):
    def store():
        return TableStore(spark, str(tmp_path / "s"), {"f": "k bigint, y int, s bigint"}, {"f": "y"}, {"f": bucket("k", 64)}, {"f": "s"})

    s = store()
    assert s.next_number("f") == 1
    s.replace("f", spark.range(5000).selectExpr("id as k", "cast(2020 + id % 3 as int) as y", "id + 1 as s"))
    assert s.next_number("f") == 5001
    s.publish()
    asked = spark.createDataFrame([(k,) for k in range(0, 5000, 500)], "k bigint")
    found = store().read_keys("f", asked)
    assert len(set(found.inputFiles())) <= 30 < len(set(store().read("f").inputFiles())) / 5  # 10 keys: ten buckets of three years at most
    assert found.join(asked, "k").count() == 10
    s = store()
    s.append("f", spark.createDataFrame([(1, 2020, 9000)], "k bigint, y int, s bigint"))
    s.publish()
    again = store()
    plans = []
    again._open = lambda *a: plans.append(a)  # no stored row is looked at
    assert again.next_number("f") == 9001 and not plans
    part = store().parts_of("f", spark.createDataFrame([(1, 2020)], "k bigint, y int"))
    s.replace_parts("f", s.read_parts("f", part), part)
    assert s.next_number("f") == 9001 and s.read("f").count() == 5001
    s.replace("f", s.read("f").where("s < 10"))
    assert s.next_number("f") == 10


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("state")
    rows = make_rows(students=40, enrollments=120, exams=150)
    write_sources(folder / "sources", rows)
    world = World(spark, folder)
    run_full_load(spark, str(folder / "sources"), world.staging.root, world.warehouse.root, f"{folder}/audit", dt.date(2026, 3, 1), dt.datetime(2026, 3, 1))
    for store in (world.staging, world.warehouse):
        store.discard()
    return world


def deliver(world, source, when, *rows, **more):
    world.add(source, when, *[_row(source, *r) for r in rows], **more)


def test_a_smaller_id_that_comes_later(loaded):
    """Id 7000009 is loaded with facts; 7000005 of the same person comes later."""
    when = dt.datetime(2026, 9, 1, 8)
    person = (95_123_456, "Paz", "Ana", "F", "2001", "", "", "", 3, 2024)
    deliver(loaded, "dictado", when, (8000001, 1, 1, 6, 2026, "C1", "Mañana", "A", 60), (8000002, 1, 1, 6, 2026, "C1", "Mañana", "A", 60))
    deliver(loaded, "estudiante", when, (7000009, *person))
    deliver(loaded, "inscripcion", when, (7100001, 7000009, 8000001, "2026-03-10", "Activa"), (7100002, 7000009, 8000002, "2026-03-10", "Activa"))
    deliver(loaded, "examen", when, (7200001, 7100001, "2026-07-10", "7.00", 1, "Aprobado"), (7200002, 7100002, "2026-07-10", "2.00", 1, "Desaprobado"))
    first = run_incremental(loaded.staging, loaded.warehouse, loaded.audit, dt.datetime(2026, 9, 1, 9), dt.date(2026, 9, 1))
    assert first.canonical["cargados"] == 0 and first.history == {"aceptados": 2, "rechazados": 0}

    when = dt.datetime(2026, 9, 2, 8)
    deliver(loaded, "estudiante", when, (7000005, *person))
    deliver(loaded, "inscripcion", when, (7100003, 7000005, 8000002, "2026-04-10", "Activa"))
    deliver(loaded, "examen", when, (7200003, 7100001, "2026-08-10", "9.00", 1, "Aprobado"), (7200004, 7100003, "2026-08-10", "9.00", 1, "Aprobado"))
    report = run_incremental(loaded.staging, loaded.warehouse, loaded.audit, dt.datetime(2026, 9, 2, 9), dt.date(2026, 9, 2), move_absorbed=True)
    # The enrollment of 7000005 repeats 7100002, so nothing of it stands in the way.
    assert report.canonical == {"cambiados": 1, "cargados": 1, "movidas": 4, "retenidas": 0}
    # Another pass of 8000001 is one too many, the second attempt at 8000002 is not.
    assert report.history == {"aceptados": 1, "rechazados": 1}
    enrolled = loaded.facts("fact_inscripcion", "idalumno", "idDictado")
    assert [r for r in enrolled if r[0] > 7_000_000] == [(7000005, 8000001), (7000005, 8000002)]
    exams = [r for r in loaded.facts("fact_examen_estudiante", "idalumno", "idDictado", "nroIntentos", "aprobado") if r[0] > 7_000_000]
    assert exams == [(7000005, 8000001, 1, True), (7000005, 8000002, 1, False), (7000005, 8000002, 2, True)]
    versions = loaded.warehouse.read("dim_estudiante").where("idalumno in (7000005, 7000009)").orderBy("idalumno").collect()
    assert [(v.idalumno, v.es_actual, v.valid_to) for v in versions] == [(7000005, True, None), (7000009, False, dt.date(2026, 9, 2))]


def test_rows_in_the_way_stay(spark):
    schema = "s bigint, a bigint, d bigint, n int"
    fact = spark.createDataFrame([(1, 9, 1, 1), (2, 9, 2, 1), (3, 5, 2, 1), (4, 8, 3, 1), (5, 7, 3, 1), (6, 6, 6, 6)], schema)
    changed = spark.createDataFrame([(9, 5), (8, 5), (7, 5), (6, None)], "clave bigint, clave_nueva bigint")
    found = repoint.repoint(fact, changed, "a", ["a", "d"], "s")
    assert {(r.s, r.a) for r in found.moved.collect()} == {(1, 5), (4, 5)}
    assert {(r.s, r.a) for r in found.blocked.collect()} == {(2, 9), (5, 7)}
    assert {r.s for r in repoint.repoint(fact, changed, "a", [], "s").moved.collect()} == {1, 2, 4, 5}


def test_a_replaced_table_is_compared(loaded):
    """Of a full re-delivery only new and changed rows are loaded, and versions of deleted rows closed."""
    loaded.staging.discard()
    table = STUDENTS
    old = loaded.staging.read(table)
    current = loaded.warehouse.read("dim_estudiante").where("es_actual").select("idalumno").collect()
    gone, changed = sorted(r.idalumno for r in current)[:2]
    new = old.where(F.trim("id_estudiante_raw") != str(gone)).withColumn(
        "nacionalidad_raw", F.when(F.trim("id_estudiante_raw") == str(changed), "Chile").otherwise(F.col("nacionalidad_raw"))
    )
    with loaded.staging.transaction():
        loaded.staging.replace(table, new)
    report = run_incremental(loaded.staging, loaded.warehouse, loaded.audit, dt.datetime(2026, 9, 3, 9), dt.date(2026, 9, 3), snapshots=True)
    staged_changed = old.where(F.trim("id_estudiante_raw") == str(changed)).count()
    assert report.delta_rows == staged_changed
    assert report.deleted["estudiantes"] == 1
    assert report.students["insertados"] + report.students["actualizados_scd1"] + report.students["sin_cambios"] <= staged_changed
    closed = loaded.warehouse.read("dim_estudiante").where(f"idalumno = {gone}").collect()
    assert closed and not any(v.es_actual for v in closed)


def test_a_changed_student_rewrites_one_bucket(spark, tmp_path):
    warehouse = open_warehouse(spark, str(tmp_path / "w"), buckets=16)
    schema = u.WAREHOUSE_SCHEMAS["dim_estudiante"]
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    rows = spark.range(1, 400).selectExpr("id as alumnoSKey", "id as idalumno", "true as es_actual", "date'2024-01-01' as valid_from", "'P' as nombrePrograma", "'Ana' as nombre")
    warehouse.replace("dim_estudiante", rows)
    warehouse.publish()
    before = set(warehouse._folders("dim_estudiante"))
    delta = warehouse.read("dim_estudiante").where("idalumno = 17").withColumn("nombrePrograma", F.lit("Q")).withColumn("row_id", F.lit(1)).drop("alumnoSKey")
    counts = merge_dimension(warehouse, "dim_estudiante", delta, u.STUDENT_POLICY, dt.date(2025, 1, 1))
    after = set(warehouse._folders("dim_estudiante"))
    assert counts["actualizados_scd2"] == 1
    assert len(before) == 16 and len(before - after) == 1 and len(after - before) == 2
    versions = warehouse.read("dim_estudiante").where("idalumno = 17").orderBy("alumnoSKey").collect()
    assert [(v.alumnoSKey, v.es_actual, v.nombrePrograma) for v in versions] == [(17, False, "P"), (400, True, "Q")]
    assert set(warehouse.read("dim_estudiante").columns) == set(names)


def test_of_two_writers_the_second_is_refused(spark, tmp_path):
    def store():
        return TableStore(spark, str(tmp_path / "s"), {"t": "k int", "u": "k int"})

    rows = spark.createDataFrame([(1,)], "k int")
    first, second, third = store(), store(), store()
    first.append("t", rows)
    second.append("t", rows)
    third.append("u", rows)
    assert first.publish() == 1
    with pytest.raises(ConflictingWriter, match="^t of"):
        second.publish()
    # Its changes are dropped, and it goes on from the state of the other one.
    assert second.publish() == 1 and second.read("t").count() == 1
    # A writer of another table is not in the way, and its rows are new after the version before it.
    assert third.publish() == 2
    reader = store()
    assert reader.read_since("u", 1).count() == 1 and reader.read_since("u", 2).count() == reader.read_since("t", 1).count() == 0
    with pytest.raises(ConflictingWriter), first.transaction():
        first.append("t", rows)
        other = store()
        other.append("t", rows)
        other.publish()
    assert store().version() == 3 and store().read("t").count() == 2
    assert not list((tmp_path / "s" / "_publicando").glob("*"))


def test_a_batch_that_breaks_rules_publishes_nothing(loaded, monkeypatch):
    """Facts that repeat a key and miss a parent are listed with their keys."""
    from starloom.plans import incremental

    for store in (loaded.staging, loaded.warehouse):
        store.discard()
    counts = {t: loaded.warehouse.read(t).count() for t in loaded.warehouse.schemas}
    student = loaded.warehouse.read("dim_estudiante").where("es_actual and idalumno < 7000000").agg(F.min("idalumno")).first()[0]
    deliver(loaded, "inscripcion", dt.datetime(2026, 9, 5, 8), (7100009, student, 8000001, "2026-05-10", "Activa"))
    merge = incremental.merge_fact

    def broken(warehouse, table, rows, update):
        twice = rows.unionByName(rows).withColumn("dictadoSKey", F.lit(987654).cast("bigint"))
        warehouse.append(table, twice.withColumn(u.FACT_SURROGATES[table], F.lit(1).cast("bigint")))
        return {"insertados": 0, "actualizados": 0}

    monkeypatch.setattr(incremental, "merge_fact", broken)
    with pytest.raises(incremental.BrokenRules) as failure:
        run_incremental(loaded.staging, loaded.warehouse, loaded.audit, dt.datetime(2026, 9, 5, 9), dt.date(2026, 9, 5))
    monkeypatch.setattr(incremental, "merge_fact", merge)
    found = {(r.tabla, r.regla.split("(")[0], r.clave.split(", ")[-1], r.filas) for r in failure.value.rows}
    assert found == {("fact_inscripcion", "unica", "987654", 2), ("fact_inscripcion", "existe", "987654", 2)}
    assert {t: loaded.warehouse.read(t).count() for t in counts} == counts
    assert "fact_inscripcion" in loaded.audit.runs().orderBy(F.desc("id")).first().mensaje_error
    assert run_incremental(loaded.staging, loaded.warehouse, loaded.audit, dt.datetime(2026, 9, 5, 10), dt.date(2026, 9, 5)).delta_rows == 1
