"""The full load worked out row by row in plain Python, for small fixtures only."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

from starloom.plans.university import SOURCE_COLUMNS
from starloom.sources.staging import NULL_ON_READ

LAYOUTS = ("%Y-%m-%d", "%d/%m/%Y", "%Y%m%d", "%d-%m-%Y", "%m-%d-%Y", "%Y", "%d/%m/%y", "%Y/%m/%d")


def read(rows: dict[str, list[list[str]]]) -> dict[str, list[dict]]:
    return {
        source: [
            {c: (None if v in NULL_ON_READ else v) for c, v in zip(SOURCE_COLUMNS[source], line)} for line in lines
        ]
        for source, lines in rows.items()
    }


def integer(v):
    try:
        return int(float(v.strip().translate(str.maketrans("", "", "., "))))
    except (AttributeError, ValueError, OverflowError):
        return None


def decimal(v):
    if v is None:
        return None
    v = v.strip().replace(" ", "")
    v = v.replace(".", "").replace(",", ".") if v.rfind(",") > v.rfind(".") else v.replace(",", "")
    try:
        return float(v)
    except ValueError:
        return None


def title(v):
    return None if v is None else v.strip().title()


def date(v):
    for layout in LAYOUTS if v is not None else ():
        try:
            return dt.datetime.strptime(v.strip(), layout).date()
        except ValueError:
            pass
    return None


def gender(v):
    word = (v or "").strip().upper()
    if word in {"M", "MASCULINO", "MALE", "HOMBRE", "1"}:
        return "M"
    return "F" if word in {"F", "FEMENINO", "FEMALE", "MUJER", "2"} else None


def key(d: dt.date) -> int:
    return d.year * 10000 + d.month * 100 + d.day


def first_by(rows: list[dict], column: str) -> dict:
    out: dict = {}
    for row in rows:
        out.setdefault(row[column], row)
    return out


def evaluation_dates(src: dict[str, list[dict]], as_of: dt.date) -> dict[str, str]:
    dates = {}
    for r in src["dictado"]:
        end = {"C1": "-07-15", "C2": "-12-15"}.get((r["periodo"] or "").strip().upper())
        if end and (r["anio_academico"] or "").strip().isdigit():
            dates[r["id_dictado"]] = r["anio_academico"].strip() + end
    return {r["id_evaluacion"]: dates.get(r["id_dictado"], as_of.isoformat()) for r in src["evaluacion_curso"]}


def full_load(rows: dict[str, list[list[str]]], as_of: dt.date) -> dict[str, set]:
    """Every warehouse table as a set of tuples in natural keys, duplicates counted."""
    src = read(rows)

    students = []
    for r in src["estudiante"]:
        s = dict(
            id=integer(r["id_estudiante"]), dni=integer(r["dni"]), apellido=title(r["apellido"]), nombre=title(r["nombre"]),
            genero=gender(r["genero"]), born=date(r["fecha_nacimiento"]), nacionalidad=r["nacionalidad"] or "No especificado",
            programa=integer(r["id_programa"]), anio=integer(r["anio_ingreso"]),
        )
        if None not in (s["id"], s["dni"], s["apellido"], s["nombre"], s["programa"]) and 1_000_000 <= s["dni"] <= 99_999_999:
            students.append(s)
    students = list(first_by(students, "id").values())
    smallest: dict[int, int] = {}
    for s in students:
        smallest[s["dni"]] = min(smallest.get(s["dni"], s["id"]), s["id"])
    student_map = {s["id"]: smallest[s["dni"]] for s in students if s["id"] != smallest[s["dni"]]}
    students = [s for s in students if s["id"] not in student_map]

    enrollments = []
    for r in src["inscripcion"]:
        e = dict(
            id=integer(r["id_inscripcion"]), student=integer(r["id_estudiante"]), offering=integer(r["id_dictado"]),
            day=date(r["fecha_inscripcion"]), estado=title(r["estado"]),
        )
        if None not in (e["id"], e["student"], e["offering"], e["day"]):
            enrollments.append(e)
    enrollments = list(first_by(enrollments, "id").values())
    for e in enrollments:
        e["student"] = student_map.get(e["student"], e["student"])
    absorbers = set(student_map.values())
    lowest: dict[tuple, int] = {}
    for e in enrollments:
        if e["student"] in absorbers:
            pair = e["student"], e["offering"]
            lowest[pair] = min(lowest.get(pair, e["id"]), e["id"])
    enrollment_map = {
        e["id"]: lowest[e["student"], e["offering"]]
        for e in enrollments
        if e["student"] in absorbers and lowest[e["student"], e["offering"]] != e["id"]
    }
    enrollments = [e for e in enrollments if e["id"] not in enrollment_map]
    owner = {e["id"]: (e["student"], e["offering"]) for e in enrollments}

    exams = []
    for r in src["examen"]:
        x = dict(
            id=integer(r["id_examen"]), enrollment=integer(r["id_inscripcion"]), day=date(r["fecha"]), nota=decimal(r["nota"]),
            attempt=integer(r["numero_intento"]), passed=(title(r["resultado"]) or "").lower() == "aprobado",
        )
        if x["nota"] is not None and not 0 <= x["nota"] <= 10:
            x["nota"] = None
        if None not in (x["id"], x["enrollment"], x["day"], x["nota"], x["attempt"]) and x["attempt"] > 0:
            exams.append(x)
    exams = list(first_by(exams, "id").values())
    for x in exams:
        x["enrollment"] = enrollment_map.get(x["enrollment"], x["enrollment"])
    touched = set(enrollment_map) | set(enrollment_map.values())
    groups = defaultdict(list)
    kept = []
    for x in exams:
        if x["enrollment"] in touched and x["enrollment"] in owner:
            groups[owner[x["enrollment"]]].append(x)
        else:
            kept.append(x)
    for group in groups.values():
        seen, n, done = set(), 0, False
        for x in sorted(group, key=lambda x: (x["day"], x["id"])):
            if x["day"] in seen or done:
                continue
            seen.add(x["day"])
            n += 1
            kept.append(dict(x, attempt=n))
            done = x["passed"]

    teachers = {integer(r["id_docente"]): r for r in src["docente"]}
    courses = {integer(r["id_curso"]): r for r in src["curso"] if r["nombre"] is not None}
    departments = {integer(r["id_departamento"]): r for r in src["departamento"]}
    faculties = {integer(r["id_facultad"]): r for r in src["facultad"]}
    programs = {integer(r["id_programa"]): r for r in src["programa"]}

    def positive(v):
        n = integer(v)
        return n if n is not None and n >= 0 else None

    offerings = {}
    for r in src["dictado"]:
        i, c, d = integer(r["id_dictado"]), integer(r["id_curso"]), integer(r["id_docente"])
        if None in (i, c, d) or i in offerings:
            continue
        course, teacher = courses.get(c, {}), teachers.get(d, {})
        department = departments.get(integer(teacher.get("id_departamento")), {})
        faculty = faculties.get(integer(department.get("id_facultad")), {})
        offerings[i] = (
            i, title(r["periodo"]), title(r["turno"]), title(r["aula"]), positive(r["cupo_maximo"]), title(course.get("codigo")),
            title(course.get("nombre")), positive(course.get("horas_teorica")), title(teacher.get("dedicacion")),
            title(department.get("nombre")), title(faculty.get("nombre")), title(faculty.get("provincia")),
        )

    def age(s):
        n = s["anio"] - s["born"].year if s["anio"] and s["born"] else None
        return n if n is not None and 0 <= n <= 120 else None

    known = {s["id"] for s in students}
    evaluated = evaluation_dates(src, as_of)
    evaluations = [
        (integer(r["id_dictado"]), key(date(evaluated[r["id_evaluacion"]])), decimal(r["puntaje_dictado"]), decimal(r["valoracion_general"]))
        for r in src["evaluacion_curso"]
    ]
    last_enrollment = {
        (e["student"], e["offering"]): (key(e["day"]), e["estado"], (e["estado"] or "").lower() in {"abandonada", "abandonado", "abandono", "baja"})
        for e in enrollments
        if e["student"] in known and e["offering"] in offerings
    }
    last_exam = {}
    for x in sorted(kept, key=lambda x: (x["day"], x["id"])):
        student, offering = owner.get(x["enrollment"], (None, None))
        if student in known and offering in offerings:
            last_exam[student, offering, x["attempt"]] = (key(x["day"]), x["nota"], x["passed"])
    days = {e["day"] for e in enrollments} | {x["day"] for x in kept} | {date(d) for d in evaluated.values()}
    return {
        "dim_tiempo": sorted(key(d) for d in days),
        "dim_estudiante": sorted(
            (
                s["id"], s["dni"], s["nombre"], s["genero"] or "", str(s["born"]), s["nacionalidad"], s["anio"] or 0,
                age(s) if age(s) is not None else -1, title(programs.get(s["programa"], {}).get("nombre")) or "",
            )
            for s in students
        ),
        "dim_dictado": sorted((tuple("" if v is None else str(v) for v in row) for row in offerings.values())),
        "fact_inscripcion": sorted((*k, v[0], v[1] or "", v[2]) for k, v in last_enrollment.items()),
        "fact_examen_estudiante": sorted((*k, *v) for k, v in last_exam.items()),
        "fact_evaluacion_dictado": sorted(e for e in evaluations if e[0] in offerings),
        "maps": (student_map, enrollment_map),
    }
