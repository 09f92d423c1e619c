"""Column profiles as sketches: one pass over all columns, parts merged later.

A sketch row per column holds, beside exact counts, a HyperLogLog for its different values, a
KLL sketch for its quantiles (of text: of its length) and a frequent-items sketch for its digit
patterns. Sketches of parts, such as the days or folders of a table, are merged without reading
the rows again. The profile with exact figures is ``profile.column_profile``.

Errors: different values 0.8 % standard deviation (2.5 % in 99.7 of 100 cases); a quantile is a
value of a rank within 1.7 % of the rows of the one asked for; the count of a pattern is too
large by 3.5 / ``TRACKED`` of the rows at most, and a pattern with more rows than that is listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from starloom.functions import digit_mask

DISTINCT_BITS, QUANTILE_SIZE, TRACKED = 14, 200, 1_024
DISTINCT_ERROR, RANK_ERROR, PATTERN_ERROR = 0.025, 0.017, 3.5 / TRACKED
QUANTILES = (0.25, 0.5, 0.75)
PATTERNS = 5


def _measure(df: DataFrame, name: str) -> Column:
    """The number that quantiles of a column are about."""
    column = F.col(f"`{name}`")
    return column.cast("double") if isinstance(df.schema[name].dataType, NumericType) else F.length(column.cast("string")).cast("double")


def sketch_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: ``column``, ``rows``, ``present`` and the three sketches; one scan for all columns."""
    columns = list(columns or df.columns)
    prepared = df.select(
        *[F.col(f"`{c}`").cast("string").alias(f"_v{i}") for i, c in enumerate(columns)],
        *[_measure(df, c).alias(f"_m{i}") for i, c in enumerate(columns)],
        *[digit_mask(F.col(f"`{c}`").cast("string")).alias(f"_p{i}") for i, c in enumerate(columns)],
    )
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        aggregates += [
            F.count(f"_v{i}").alias(f"_n{i}"),
            F.hll_sketch_agg(f"_v{i}", F.lit(DISTINCT_BITS)).alias(f"_h{i}"),
            F.kll_sketch_agg_double(f"_m{i}", F.lit(QUANTILE_SIZE)).alias(f"_k{i}"),
            F.expr(f"approx_top_k_accumulate(_p{i}, {TRACKED})").alias(f"_t{i}"),
        ]
    row = prepared.agg(*aggregates)
    lines = [
        F.struct(
            F.lit(c).alias("column"), "rows", F.col(f"_n{i}").alias("present"), F.col(f"_h{i}").alias("distinct_sketch"),
            F.col(f"_k{i}").alias("quantile_sketch"), F.col(f"_t{i}").alias("pattern_sketch"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*lines)))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of all parts of a table as those of the whole."""
    return sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("present").alias("present"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", F.lit(QUANTILE_SIZE)).alias("quantile_sketch"),
        F.expr(f"approx_top_k_combine(pattern_sketch, {TRACKED})").alias("pattern_sketch"),
    )


def estimates(sketches: DataFrame) -> DataFrame:
    """The profile that sketches give: ``distinct``, ``quantiles`` and the commonest ``patterns`` with their rows.

    Of a column without a value the quantiles are null and there is no pattern.
    """
    filled = F.col("present") > 0
    shares = ", ".join(f"{q}D" for q in QUANTILES)
    quantiles = F.expr(f"kll_sketch_get_quantile_double(quantile_sketch, array({shares}))")
    patterns = F.expr(f"approx_top_k_estimate(pattern_sketch, {PATTERNS})")
    return sketches.select(
        "column",
        "rows",
        "present",
        (F.col("rows") - F.col("present")).alias("missing"),
        F.when(filled, F.hll_sketch_estimate("distinct_sketch")).otherwise(F.lit(0)).cast("bigint").alias("distinct"),
        F.when(filled, quantiles).alias("quantiles"),
        F.transform(
            F.filter(patterns, lambda p: p.item.isNotNull()), lambda p: F.struct(p.item.alias("pattern"), p["count"].alias("rows"))
        ).alias("patterns"),
    )
