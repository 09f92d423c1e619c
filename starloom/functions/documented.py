"""Stricter cleaning rules that are described for the warehouse but not applied by default.

The pipelines do not use them; pass them to an ``Entity`` in place of the default
cleaners to switch them on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.numbers import clean_decimal
from starloom.functions.text import FEMALE_WORDS, MALE_WORDS, strip

# Tokens that mean "no text".
TEXT_NULL_TOKENS = ("", "null", "none", "n/a", "na", "sin dato", "s/d")

# Spellings accepted for the third gender code.
OTHER_WORDS = ("X", "OTRO", "NO BINARIO", "NB")

# Spellings of each enrollment state.
STATES = {
    "Activa": ("activa", "activo", "inscripto", "cursando", "regular"),
    "Aprobada": ("aprobada", "finalizada"),
    "Abandonada": ("abandonada", "baja"),
    "Cancelada": ("cancelada", "anulada", "rechazada"),
}

# Spellings of a passed and a failed exam, and the grade that passes.
PASSED_WORDS = ("aprobado", "sí", "true", "1")
FAILED_WORDS = ("desaprobado", "no", "false", "0", "ausente", "pendiente")
PASS_GRADE = 4

# UTF-8 text that was read as Latin-1: every high character is part of a whole sequence.
_MISREAD = (
    r"^(?:[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3})*"
    r"[\xC2\xC3][\x80-\xBF](?:[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3})*$"
)


def _by_word(word: Column, codes: dict[str, tuple[str, ...]]) -> Column:
    pairs = [F.lit(x) for code, words in codes.items() for w in words for x in (w, code)]
    return F.try_element_at(F.create_map(*pairs), word)


def repair_encoding(c: Column) -> Column:
    """Undo one wrong decoding of UTF-8 text; other text is left alone."""
    return F.when(c.rlike(_MISREAD), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)


def clean_text(c: Column) -> Column:
    """Strip, collapse inner white space and repair the encoding; null tokens become null."""
    text = F.regexp_replace(strip(repair_encoding(c)), r"(?U)\s+", " ")
    return F.when(~F.lower(strip(c)).isin(*TEXT_NULL_TOKENS), text)


def clean_gender_with_other(c: Column) -> Column:
    codes = {"M": MALE_WORDS, "F": FEMALE_WORDS, "X": OTHER_WORDS}
    return _by_word(F.upper(strip(c)), codes)


def canonical_state(c: Column) -> Column:
    """One of the four enrollment states; unknown ones are left alone."""
    return F.coalesce(_by_word(F.lower(strip(c)), STATES), c)


def passed_or_inferred(result: Column, grade: Column) -> Column:
    """Passed by the words of the result, or by the grade where there is no text."""
    word = F.lower(strip(result))
    return (
        F.when(F.coalesce(word, F.lit("")) == "", F.coalesce(grade >= PASS_GRADE, F.lit(False)))
        .when(word.isin(*PASSED_WORDS), F.lit(True))
        .when(word.isin(*FAILED_WORDS), F.lit(False))
    )


def truncated_integer(c: Column) -> Column:
    """An integer from text with decimals, which are cut off."""
    return clean_decimal(c).try_cast("bigint")


def valid_score(c: Column) -> Column:
    return F.coalesce(c.between(0, 10), F.lit(False))
