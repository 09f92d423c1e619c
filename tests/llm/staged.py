"""Staged rows for the tests of this folder: course names and longer descriptions as ``nombre_raw``."""

from __future__ import annotations

import random

import public_tokenizers
from fixtures import make_rows

from starloom.plans import university as u

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

SPANISH = "el curso de analisis matematico para los alumnos del primer año con ejercicios y una evaluación final".split()
ENGLISH = "the course on mathematical analysis for students of their first year with exercises and one final exam".split()


def sentence(rng: random.Random, vocabulary: list[str], words: int) -> str:
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def frame(spark, rows, schema="row_id bigint, nombre_raw string"):
    return spark.createDataFrame(rows, schema)


# What every operator has to take: nulls, empty and blank texts, repeats, a very long text.
ODD_TEXTS = [None, "", " \t\n", "a", "Álgebra I", "Álgebra I", "¿?! 123 ###", "Señal\x00 y\u00a0Sistemas", "x" * 70_000, "uno dos " * 20_000, "𝔘 漢字 العربية"]


def odd_rows(spark):
    return frame(spark, [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "sin clave")])


def staging(spark, table):
    """A staging table of the project, as ``U.STAGING_SCHEMAS`` describes it, from the rows of the small university."""
    columns = [f"{c}_raw" for c in u.SOURCE_COLUMNS[table]]
    rows = [(i, *[v or None for v in row], "archivo.csv", None) for i, row in enumerate(make_rows()[table], 1)]
    schema = ", ".join(["row_id bigint", *[f"{c} string" for c in columns], "archivo_origen string", "fecha_carga timestamp"])
    return spark.createDataFrame(rows, schema)
