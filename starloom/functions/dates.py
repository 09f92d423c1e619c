"""Date cleaners and calendar attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.text import strip

# Month names of the calendar dimension.
MONTHS_ES = (
    "Enero",
    "Febrero",
    "Marzo",
    "Abril",
    "Mayo",
    "Junio",
    "Julio",
    "Agosto",
    "Septiembre",
    "Octubre",
    "Noviembre",
    "Diciembre",
)

# Spellings of the two academic periods.
FIRST_PERIOD_WORDS = ("C1", "1", "P1", "PRIMER", "PRIMERO")
SECOND_PERIOD_WORDS = ("C2", "2", "P2", "SEGUNDO")

_MONTH = "(1[0-2]|0[1-9]|[1-9])"
_DAY = r"(3[01]|[12]\d|0[1-9]|[1-9])"

_YEAR = r"((?!0000)\d\d\d\d)"

# A time of day after a full date is read over.
_TIME = r"(?:[T ]+\d\d?:\d\d(?::\d\d(?:[.,]\d+)?)?(?: ?[AaPp][Mm])?(?:Z|[+-]\d\d:?\d\d)?)?"

# Day first, year first and month first in one pattern, and their ISO form; text in
# no layout comes out as "--". No text fits two layouts in a different sense, for
# where a day-first reading has a day past 12, a month-first one has no such month.
_FULL = rf"(?s)^(?:(?:{_DAY}([-/]){_MONTH}\2{_YEAR}|{_YEAR}([-/]?){_MONTH}\6{_DAY}|{_MONTH}-{_DAY}-{_YEAR}){_TIME}|.*)$"
_FULL_ISO = "$4$5$11-$3$7$9-$1$8$10"
_SHORT = rf"(?s)^(?:{_DAY}/{_MONTH}/(\d\d)|.*)$"
_YEAR_ONLY = rf"(?s)^(?:{_YEAR}|.*)$"

# The usual layouts, which need no more than their parts put in order.
_PLAIN_ISO = r"^(?!0000)[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?: [0-9]{2}:[0-9]{2}:[0-9]{2})?\z"
_PLAIN_DAY_FIRST = r"^(?:0[1-9]|[12][0-9]|3[01])([-/])(?:0[1-9]|1[0-2])\1(?!0000)[0-9]{4}\z"


def clean_date(c: Column) -> Column:
    """Date from the supported layouts, for any year of four digits.

    ``Y-M-D``, ``D/M/Y``, ``YMD``, ``D-M-Y``, ``M-D-Y``, ``Y``, ``D/M/y``, ``Y/M/D``.
    A two-digit year from 69 on belongs to the 1900s. A time of day may follow a
    full date. Text in any other layout, and days that do not exist, become null.
    """
    text = strip(c)
    century = F.when(F.right(text, F.lit(2)) >= "69", F.lit("19")).otherwise(F.lit("20"))
    day_first = F.concat(F.substring(c, 7, 4), F.lit("-"), F.substring(c, 4, 2), F.lit("-"), F.substring(c, 1, 2))
    iso = (
        F.when(c.rlike(_PLAIN_DAY_FIRST), day_first)
        .when(c.rlike(_PLAIN_ISO), F.substring(c, 1, 10))
        .when(F.length(text) == 4, F.regexp_replace(text, _YEAR_ONLY, "$1-01-01"))
        .when((F.length(text) <= 8) & (F.substring(text, -3, 1) == "/"), F.concat(century, F.regexp_replace(text, _SHORT, "$3-$2-$1")))
        .otherwise(F.regexp_replace(text, _FULL, _FULL_ISO))
    )
    return iso.try_cast("date")


def year_start(year: Column, as_of_year: int) -> Column:
    """1 January of a plausible year: 1900 to ten years past ``as_of_year``."""
    return F.when(year.between(1900, as_of_year + 10), F.make_date(year.cast("int"), F.lit(1), F.lit(1)))


def age_at(birth: Column, year: Column) -> Column:
    """Difference in calendar years, null outside 0 to 120."""
    age = (year - F.year(birth)).cast("int")
    return F.when(age.between(0, 120), age)


def date_key(d: Column) -> Column:
    """``YYYYMMDD`` as an integer."""
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def academic_period(d: Column) -> Column:
    return F.concat(F.when(F.month(d) <= 7, F.lit("C1-")).otherwise(F.lit("C2-")), F.year(d).cast("string"))


def month_name_es(d: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(name) for name in MONTHS_ES]), F.month(d))


def evaluation_date(period: Column, year: Column) -> Column:
    """ISO text for the end of an academic period, null when either part is unknown."""
    word = F.upper(strip(period))
    digits = strip(year)
    return F.when(
        digits.rlike(r"^\d+$"),
        F.when(word.isin(*FIRST_PERIOD_WORDS), F.concat(digits, F.lit("-07-15"))).when(
            word.isin(*SECOND_PERIOD_WORDS), F.concat(digits, F.lit("-12-15"))
        ),
    )
