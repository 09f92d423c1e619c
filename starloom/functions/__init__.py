"""Column expressions for cleaning raw text, built only from Spark functions."""

from starloom.functions.compare import columns_changed, value_changed
from starloom.functions.dates import (
    academic_period,
    age_at,
    clean_date,
    date_key,
    evaluation_date,
    month_name_es,
    year_start,
)
from starloom.functions.numbers import (
    between_or_null,
    clean_decimal,
    clean_integer,
    identifier,
    is_national_id,
    non_negative,
)
from starloom.functions.text import (
    clean_gender,
    clean_nationality,
    clean_title,
    digit_mask,
    is_null_token,
    length_without_dots,
    matches_any,
    strip,
)

__all__ = [
    "academic_period",
    "age_at",
    "between_or_null",
    "clean_date",
    "clean_decimal",
    "clean_gender",
    "clean_integer",
    "clean_nationality",
    "clean_title",
    "columns_changed",
    "date_key",
    "digit_mask",
    "evaluation_date",
    "identifier",
    "is_national_id",
    "is_null_token",
    "length_without_dots",
    "matches_any",
    "month_name_es",
    "non_negative",
    "strip",
    "value_changed",
    "year_start",
]
