"""A small university with the dirt seen in real extracts, written as CSV files."""

from __future__ import annotations

import csv
import datetime as dt
import random
from pathlib import Path

from starloom.plans.university import SOURCE_COLUMNS


def _row(source: str, *values: object) -> list[str]:
    assert len(values) == len(SOURCE_COLUMNS[source]), source
    return ["" if v is None else str(v) for v in values]


def make_rows(seed: int = 7, students: int = 120, enrollments: int = 700, exams: int = 900) -> dict[str, list[list[str]]]:
    rng = random.Random(seed)
    rows: dict[str, list[list[str]]] = {s: [] for s in SOURCE_COLUMNS}
    for i in range(1, 4):
        rows["facultad"].append(_row("facultad", i, f"FACULTAD regional-{i}", "córdoba", "Santa fe"))
    for i in range(1, 6):
        rows["departamento"].append(_row("departamento", i, f"ciencias básicas {i}", i % 4 + 1))
    for i in range(1, 8):
        rows["programa"].append(_row("programa", i, f"ingeniería {i}", "GRADO", rng.choice([5, 3]), i % 3 + 1))
    for i in range(1, 10):
        hours = rng.choice([60, 30, -5, "n/a"])
        rows["curso"].append(_row("curso", i, f"mat100{i}", f"álgebra {i}", hours, 30, 15, 2019, i % 5))
    rows["curso"].append(_row("curso", 10, "FIS1", None, 1, 1, 1, 2019, 1))
    for i in range(1, 8):
        rows["curso_programa"].append(_row("curso_programa", i, i))
    for i in range(1, 7):
        rows["docente"].append(_row("docente", i, "garcía", f"ana {i}", "doctora", "titular", "semi-exclusiva", i))
    for i in range(1, 31):
        rows["dictado"].append(
            _row("dictado", i, rng.randint(1, 11), rng.randint(1, 7), rng.randint(1, 7), rng.choice(["2022", "2023", "x"]),
                 rng.choice(["c1", "C2", "anual"]), "mañana", f"AULA-{i}b", rng.choice([40, -1, "1.200"]))
        )
    rows["dictado"].append(_row("dictado", 31, None, 1, 1, "2022", "C1", "noche", "A", 10))
    for i in range(1, students + 1):
        dni = 30_000_000 + rng.randint(1, students)
        text = rng.choice([str(dni), f"{dni:,}".replace(",", "."), f" {dni}"])
        if i % 40 == 0:
            text = rng.choice(["123", "", "abc"])
        born = dt.date(1990 + rng.randint(0, 14), rng.randint(1, 12), rng.randint(1, 28))
        birth = rng.choice([born.isoformat(), born.strftime("%d/%m/%Y"), str(born.year), born.strftime("%d/%m/%y"), "s/d", ""])
        rows["estudiante"].append(
            _row("estudiante", i, text, "o'connor pérez", f" juan-{i} ", rng.choice(["M", "f", "Mujer", "x", ""]), birth,
                 "a@b.c", "", rng.choice(["Argentina", "", "NULL"]), rng.choice([1, 2, 3, 7, 99]), rng.choice(["2020", "2021", ""]))
        )
    rows["estudiante"].append(rows["estudiante"][4][:])
    rows["estudiante"][-1][3] = "Later Copy"
    start = dt.date(2022, 3, 1)
    for i in range(1, enrollments + 1):
        day = start + dt.timedelta(days=rng.randint(0, 60))
        state = rng.choice(["activa", "ABANDONADA", "Baja", "aprobada", ""])
        rows["inscripcion"].append(
            _row("inscripcion", i, rng.randint(1, students), rng.randint(1, 32), day.isoformat() if i % 50 else "nunca", state)
        )
    for i in range(1, exams + 1):
        day = start + dt.timedelta(days=100 + rng.randint(0, 40))
        grade = rng.choice(["3,5", "7.00", "10", "2", "11", "s/n"])
        result = rng.choice(["Aprobado", "DESAPROBADO", "Desaprobado", ""])
        rows["examen"].append(
            _row("examen", i, rng.randint(1, enrollments), day.strftime("%d/%m/%Y"), grade, rng.choice([1, 1, 2, 3, 0]), result)
        )
    for i in range(1, 81):
        rows["evaluacion_curso"].append(_row("evaluacion_curso", i, rng.randint(1, 32), "8,5", "9.0", 7))
    return rows


def write_sources(folder: Path, rows: dict[str, list[list[str]]]) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    for source, lines in rows.items():
        with open(folder / f"{source}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out)
            writer.writerow(SOURCE_COLUMNS[source])
            writer.writerows(lines)
