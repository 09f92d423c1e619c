"""Number cleaners. Text that is not a number becomes null, never an error."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.text import strip

# The range of a valid national id (7 or 8 digits).
NATIONAL_ID_MIN = 1_000_000
NATIONAL_ID_MAX = 99_999_999

# Casting alone is too lenient ("5d" reads as 5.0), so only text of the right shape
# is passed on. Each cleaner uses its input once, so that chained expressions do
# not multiply.
_DIGITS = "[0-9]+(?:_[0-9]+)*"
_EXPONENT = "(?:[eE][+-]?[0-9]+)?"
_INTEGER = rf"^([+-]?{_DIGITS}{_EXPONENT})$"
_DECIMAL = rf"^([+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS}){_EXPONENT})$"

# Digits with at most one mark, the usual case, need no more than a cast.
_PLAIN_DECIMAL = r"^-?[0-9]{1,200}(?:[.,][0-9]+)?\z"

# A dot ahead of a last comma, or a comma ahead of a last dot, is a grouping mark.
_GROUPING = r"\.(?=.*,[^.,]*$)|,(?=.*\.[^.,]*$)"


def _digits(text: Column, shape: str) -> Column:
    return F.replace(F.regexp_extract(strip(text), shape, 1), F.lit("_"), F.lit(""))


def keep_if(value: Column, wanted: Callable[[Column], Column]) -> Column:
    """The value where a condition on it holds, else null.

    As an element of an array the value is worked out once, where ``when`` would work it out again
    for every mention.
    """
    return F.get(F.filter(F.array(value), wanted), F.lit(0))


def _finite(number: Column) -> Column:
    """Text beyond the largest double is no number."""
    return keep_if(number, lambda v: F.abs(v) != F.lit(float("inf")))


def _maybe_plain(c: Column) -> Column:
    """Whether text may be an integer as numbers are written, told by its first character and its marks.

    Casting what is no number raises an exception inside Spark, which costs ten times as much as a pattern.
    """
    grouped = reduce(lambda a, b: a | b, [F.contains(c, F.lit(mark)) for mark in "., "])
    return (c >= "-") & (c < ":") & ~grouped


def clean_integer(c: Column) -> Column:
    """Dots, commas and blanks are grouping marks: ``34.157.347`` is 34157347.

    Plain digits are read exactly; only text with an exponent goes through a double.
    Text that is just what its number is written as, the usual case, needs no pattern.
    """
    plain = c.try_cast("bigint")
    digits = _digits(F.translate(c, "., ", ""), _INTEGER)
    large = digits.try_cast("double").try_cast("bigint")
    exponent = F.contains(c, F.lit("e")) | F.contains(c, F.lit("E"))
    shaped = F.when(digits == "", None).when(exponent, large).otherwise(digits.try_cast("bigint"))
    return F.when(_maybe_plain(c) & (plain.cast("string") == c), plain).otherwise(shaped)


def clean_decimal(c: Column) -> Column:
    """The right-most of ``,`` and ``.`` is the decimal mark, the other one groups."""
    plain = F.replace(c, F.lit(","), F.lit("."))
    both = F.contains(c, F.lit(".")) & F.contains(c, F.lit(","))
    ungrouped = F.translate(F.when(both, F.regexp_replace(c, _GROUPING, "")).otherwise(c), " ", "")
    digits = _digits(F.translate(ungrouped, ",", "."), _DECIMAL)
    shaped = keep_if(digits, lambda d: d != "")
    return F.when(c.rlike(_PLAIN_DECIMAL), plain.try_cast("double")).otherwise(_finite(shaped.try_cast("double")))


def identifier(c: Column) -> Column:
    """Integer id from digit-only text, null for any other text."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def is_national_id(c: Column) -> Column:
    return F.coalesce(c.between(NATIONAL_ID_MIN, NATIONAL_ID_MAX), F.lit(False))


def non_negative(c: Column) -> Column:
    return keep_if(c, lambda v: v >= 0)


def between_or_null(c: Column, low: float, high: float) -> Column:
    return keep_if(c, lambda v: v.between(low, high))
