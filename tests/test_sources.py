"""CSV staging, the table store, and the streaming landing folder."""

from __future__ import annotations

import datetime as dt
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fixtures import make_rows, write_sources
from starloom.plans import university as u
from starloom.plans.initial_load import check_sources, load_staging, load_warehouse, open_staging, open_warehouse
from starloom.session import materialize
from starloom.sources.audit import AuditLog
from starloom.sources.staging import BROKEN_LINE, BrokenSource, LineReport, line_report, number_in_file_order, read_csv, stage
from starloom.sources.store import TableStore
from starloom.streaming.landing import ingest, run_cycle, run_periodically


def test_csv_text_is_kept(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"x, ""y""", 1 \nNA,none\nnull,\n007,n/a\n', encoding="utf-8")
    got = read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"]).drop(BROKEN_LINE).collect()
    assert [tuple(r) for r in got] == [('x, "y"', " 1 "), (None, "none"), (None, None), ("007", None)]


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"x\ny",1\n', encoding="utf-8")
    got = read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"], multi_line=True).drop(BROKEN_LINE).collect()
    assert [tuple(r) for r in got] == [("x\ny", "1")]


def lines_of(spark, tmp_path, text, **options):
    (tmp_path / "t.csv").write_text(text, encoding="utf-8")
    return line_report(materialize(read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"], **options)), "t", ["a", "b"])


def test_lines_that_do_not_fit(spark, tmp_path):
    assert lines_of(spark, tmp_path, 'a,b\n1,2\n3\n"4, ""x""",5\n') == LineReport(3, 1)
    assert lines_of(spark, tmp_path, 'a,b\n"x\ny",1\n', multi_line=True) == LineReport(1, 0)
    assert lines_of(spark, tmp_path, "a,b\n") == LineReport(0, 0)
    for text, why in (("a,b\n1,2,3\n4,5\n", "more than 2"), ('a,b\n"x\ny",1\n', "quotes"), ('a,b\n1,"x\ny"\n', "quotes")):
        with pytest.raises(BrokenSource, match=why):
            lines_of(spark, tmp_path, text)


@pytest.mark.parametrize("line", ["1,2,", "1,2,,", "1,2,,4", '"1",,""', "1,,,,5", ",,"])
def test_surplus_fields_may_be_empty(spark, tmp_path, line):
    with pytest.raises(BrokenSource, match="1 lines have more than 2"):
        lines_of(spark, tmp_path, f"a,b\n4,5\n{line}\n6\n")


def test_broken_and_empty_extracts_leave_the_tables(spark, tmp_path):
    staging, rows = open_staging(spark, str(tmp_path / "stg")), make_rows(students=10, enrollments=5, exams=5)
    write_sources(tmp_path / "src", rows)
    moment = (dt.datetime(2024, 1, 1), dt.date(2024, 1, 1))
    load_staging(staging, str(tmp_path / "src"), *moment)
    facultad = (tmp_path / "src" / "facultad.csv").read_text(encoding="utf-8")
    (tmp_path / "src" / "facultad.csv").write_text(facultad.splitlines()[0] + "\n", encoding="utf-8")
    report = {r.tabla: r for r in load_staging(staging, str(tmp_path / "src"), *moment).collect()}
    assert not report["stg_facultad"].publicada and report["stg_programa"].publicada
    assert staging.read("stg_facultad").count() == len(rows["facultad"])
    (tmp_path / "src" / "facultad.csv").write_text(facultad + "1,2,3,4,5\n", encoding="utf-8")
    before = staging.version()
    with pytest.raises(BrokenSource):
        load_staging(staging, str(tmp_path / "src"), *moment)
    assert staging.version() == before and staging.read("stg_programa").count() == len(rows["programa"])


def test_landing_a_broken_file_stages_nothing(spark, tmp_path):
    staging = open_staging(spark, str(tmp_path / "stg"))
    (tmp_path / "landing" / "curso_programa").mkdir(parents=True)
    (tmp_path / "landing" / "curso_programa" / "f.csv").write_text("id_curso,id_programa\n1,2\n3,4,5\n", encoding="utf-8")
    with pytest.raises(Exception, match="more than 2"):
        ingest(staging, str(tmp_path / "landing"), str(tmp_path / "cp"), "curso_programa").awaitTermination()
    assert staging.read("stg_curso_programa").isEmpty() and staging.version() == 0


def test_csv_header_must_match(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,c\n1,2\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect()


def test_row_numbers_follow_files_and_splits(spark, tmp_path):
    for name, first in (("part-0.csv", 0), ("part-1.csv", 5000)):
        lines = "\n".join(str(i) for i in range(first, first + 5000))
        (tmp_path / name).write_text("a\n" + lines + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = number_in_file_order(read_csv(spark, str(tmp_path), ["a"]), start=100)
        got = [(r.row_id, int(r.a)) for r in numbered.orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(100 + i, i) for i in range(10000)]


def test_stage_columns(spark):
    staged = stage(spark.createDataFrame([("x",)], "a string"), "f.csv", F.lit(dt.datetime(2024, 1, 1)))
    assert [tuple(r) for r in staged.collect()] == [("x", "f.csv", dt.datetime(2024, 1, 1))]
    assert staged.columns == ["a_raw", "archivo_origen", "fecha_carga"]


def store(spark, folder):
    return TableStore(spark, str(folder), {"t": "k int, v string", "p": "k int, y int"}, {"p": "y"})


def test_store_publishes_all_or_nothing(spark, tmp_path):
    first = store(spark, tmp_path)
    first.replace("t", spark.createDataFrame([(1, "a")], "k int, v string"))
    assert store(spark, tmp_path).read("t").count() == 0
    assert first.read("t").count() == 1
    assert first.publish("one") == 1
    first.append("t", spark.createDataFrame([(2,)], "k bigint"))
    first.discard()
    assert first.read("t").count() == 1
    first.append("t", spark.createDataFrame([(2,)], "k bigint"))
    first.publish()
    assert sorted(tuple(r) for r in store(spark, tmp_path).read("t").collect()) == [(1, "a"), (2, None)]
    assert first.was_published("one") and not first.was_published("two")
    with pytest.raises(ValueError):
        first.replace("unknown", spark.range(1))


def test_transaction_forgets_everything_on_failure(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    rows = lambda *keys: spark.createDataFrame([(k, "x") for k in keys], "k int, v string")
    with s.transaction():
        s.append("t", rows(1))
    with pytest.raises(ZeroDivisionError), s.transaction():
        s.append("t", rows(2))
        s.replace("t", rows(3))
        1 / 0
    assert [r.k for r in s.read("t").collect()] == [1]
    with monkeypatch.context() as patched:
        patched.setattr(TableStore, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError), s.transaction():
            s.append("t", rows(4))
    with s.transaction():
        s.append("t", rows(4))
    assert sorted(r.k for r in s.read("t").collect()) == [1, 4]


def test_rows_since_a_version_and_compaction(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(4):
        s.append("t", spark.createDataFrame([(k, "x")], "k int, v string"))
        s.publish()
    other = store(spark, tmp_path)
    assert other.version() == 4
    for version, expected in ((None, [0, 1, 2, 3]), (0, [0, 1, 2, 3]), (2, [2, 3]), (4, [])):
        assert sorted(r.k for r in other.read_since("t", version).collect()) == expected
    s.append("t", spark.createDataFrame([(9, "x")], "k int, v string"))
    s.publish()
    assert other.read_since("t", 4).isEmpty()  # a store keeps to the state it has read
    other.discard()
    assert [r.k for r in other.read_since("t", 4).collect()] == [9]
    assert not s.compact("t", 5) and s.compact("t", 4)
    s.publish()
    assert sorted(r.k for r in s.read("t").collect()) == [0, 1, 2, 3, 9]
    assert len(s._folders("t")) == 1


def test_store_rewrites_touched_parts_only(spark, tmp_path):
    s = store(spark, tmp_path)
    s.replace("p", spark.createDataFrame([(i, 2020 + i % 3) for i in range(30)], "k int, y int"))
    s.publish()
    before = set(s.read("p").inputFiles())
    changed = s.read_parts("p", [2021]).withColumn("k", F.col("k") + 1000)
    s.replace_parts("p", changed, [2021])
    s.append("p", spark.createDataFrame([(99, 2025)], "k int, y int"))
    s.publish()
    after = set(s.read("p").inputFiles())
    assert {f for f in before - after} == {f for f in before if "parte=2021" in f}
    got = sorted(tuple(r) for r in s.read("p").collect())
    assert got == sorted([(i + (1000 if i % 3 == 1 else 0), 2020 + i % 3) for i in range(30)] + [(99, 2025)])


def test_source_report(spark, tmp_path):
    write_sources(tmp_path, {"facultad": make_rows()["facultad"]})
    report = {r.archivo: r for r in check_sources(spark, str(tmp_path)).collect()}
    assert report["facultad.csv"].existe and report["facultad.csv"].bytes > 0
    assert not report["examen.csv"].existe
    assert all(r.tabla_existe for r in report.values())


def test_landing_cycle(spark, tmp_path):
    """Files that land are staged once and loaded; a second cycle finds nothing."""
    staging, warehouse = open_staging(spark, str(tmp_path / "stg")), open_warehouse(spark, str(tmp_path / "dw"))
    audit = AuditLog(spark, str(tmp_path / "audit"))
    landing, sources = tmp_path / "landing", ["facultad", "departamento", "programa", "curso", "docente", "dictado", "estudiante", "evaluacion_curso"]
    rows = make_rows(students=20, enrollments=10, exams=10)
    for source in u.SOURCE_COLUMNS:
        (landing / source).mkdir(parents=True)
    write_sources(tmp_path / "src", rows)
    for source in sources:
        shutil.copy(tmp_path / "src" / f"{source}.csv", landing / source / "first.csv")
    load_warehouse(staging, warehouse, audit, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1))
    report = run_cycle(staging, warehouse, audit, str(landing), str(tmp_path / "cp"), sources)
    assert report.delta_rows == sum(len(rows[s]) for s in sources if s != "curso_programa")
    assert warehouse.read("dim_dictado").count() == report.offerings["insertados"] > 0
    assert report.facts["fact_evaluacion_dictado"]["insertados"] > 0
    again = run_cycle(staging, warehouse, audit, str(landing), str(tmp_path / "cp"), sources)
    assert again.delta_rows == 0
    ids = [r.row_id for r in staging.read("stg_dictado").orderBy("row_id").collect()]
    assert ids == list(range(1, len(rows["dictado"]) + 1))


def test_periodic_cycle(spark, tmp_path):
    """The clock runs whole cycles until it is stopped."""
    staging, warehouse = open_staging(spark, str(tmp_path / "stg")), open_warehouse(spark, str(tmp_path / "dw"))
    audit = AuditLog(spark, str(tmp_path / "audit"))
    (tmp_path / "landing" / "programa").mkdir(parents=True)
    write_sources(tmp_path / "src", {"programa": make_rows()["programa"]})
    shutil.copy(tmp_path / "src" / "programa.csv", tmp_path / "landing" / "programa")
    clock = run_periodically(
        staging, warehouse, audit, str(tmp_path / "landing"), str(tmp_path / "cp"), "1 second", ["programa"]
    )
    try:
        deadline = time.monotonic() + 90
        while audit.runs().where("estado = 'OK'").isEmpty() and time.monotonic() < deadline and clock.isActive:
            time.sleep(1)
    finally:
        clock.stop()
    assert clock.exception() is None
    first = audit.runs().orderBy("id").first()
    assert (first.estado, first.registros_delta) == ("OK", 7)


def test_materialized_files_can_be_cleared(tmp_path):
    """In a process of its own: the files of frames that others still read must stay."""
    script = f"""
import os
from starloom.session import build_session, clear_materialized, materialize, scratch
spark = build_session("clear", "local[2]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path)!r}}})
assert materialize(spark.range(5)).count() == 5
with scratch(spark):
    materialize(spark.range(5))
materialize(spark.range(7))
base = spark.sparkContext.getCheckpointDir()
fs = spark.sparkContext._jvm.org.apache.hadoop.fs
left = lambda: len(fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs.Path(base)))
assert left() == 2, left()
assert clear_materialized(spark) >= 2 and left() == 0 and clear_materialized(spark) == 0
print("cleared")
"""
    ran = subprocess.run([sys.executable, "-c", script], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert "cleared" in ran.stdout, ran.stderr[-2000:]
