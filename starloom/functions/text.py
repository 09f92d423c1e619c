"""Text cleaners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings accepted for each gender code.
MALE_WORDS = ("M", "MASCULINO", "MALE", "HOMBRE", "1")
FEMALE_WORDS = ("F", "FEMENINO", "FEMALE", "MUJER", "2")

# Tokens counted as "no data" when profiling a column.
NULL_TOKENS = ("", " ", "null", "none", "n/a")

# Fixed value: label for a missing nationality.
NATIONALITY_DEFAULT = "No especificado"

# What counts as white space around a value.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A word is a run of cased letters, so hyphens, digits and apostrophes open a new
# word as well as spaces do.
_WORD = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]+"
_MARK = "\u0001 "
# Plain words, the usual case of codes and names, need no marks: letters whose upper and title case are
# one and the same letter, then at most digits and signs. Words are repeated without a way back (`++`), as
# there is one way to read them: with one, Java's matcher calls itself for every word and a long text ends
# the executor by a stack overflow.
_PLAIN = "[A-Za-zÀ-ÖØ-Þà-öø-þ]+[0-9#.-]*"
_PLAIN_WORD = rf"^{_PLAIN}\z"
_PLAIN_WORDS = rf"^{_PLAIN}(?: {_PLAIN})++\z"


def strip(c: Column) -> Column:
    """Drop leading and trailing white space of any kind, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean_title(c: Column) -> Column:
    """Strip and title-case. Null stays null and empty text stays empty.

    ``initcap`` alone only opens words after a blank. Each word start gets a
    marker ending in a blank first, and the markers are taken out afterwards. A
    marker that is in the text itself is kept by doubling its first character.
    """
    escaped = F.replace(strip(c), F.lit(_MARK[0]), F.lit(_MARK[0] * 2))
    marked = F.regexp_replace(escaped, _WORD, _MARK + "$0")
    # A marker made here follows an even number of escapes, one of the text an odd number.
    unmarked = F.regexp_replace(F.initcap(marked), "((?:^|[^\u0001])(?:\u0001\u0001)*)\u0001 ", "$1")
    plain = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))
    full = F.replace(unmarked, F.lit(_MARK[0] * 2), F.lit(_MARK[0]))
    return F.when(c.rlike(_PLAIN_WORD), plain).when(c.rlike(_PLAIN_WORDS), F.initcap(c)).otherwise(full)


def clean_gender(c: Column) -> Column:
    """Code ``M`` or ``F``; anything unknown becomes null."""
    codes = [F.lit(x) for w in MALE_WORDS for x in (w, "M")] + [F.lit(x) for w in FEMALE_WORDS for x in (w, "F")]
    return F.try_element_at(F.create_map(*codes), F.upper(strip(c)))


def clean_nationality(c: Column) -> Column:
    """Default for null; present values are left as they are."""
    return F.coalesce(c, F.lit(NATIONALITY_DEFAULT))


def matches_any(c: Column, *words: str) -> Column:
    """Case-insensitive membership; null counts as no match."""
    return F.coalesce(F.lower(c), F.lit("")).isin(*words)


def digit_mask(c: Column) -> Column:
    """Every digit replaced by ``#``, to profile the shapes in a column."""
    return F.regexp_replace(c, r"\d", "#")


def length_without_dots(c: Column) -> Column:
    return F.length(F.replace(strip(c), F.lit("."), F.lit("")))


def is_null_token(c: Column) -> Column:
    return F.coalesce(c.isin(*NULL_TOKENS), F.lit(True))
