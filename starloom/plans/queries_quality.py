"""Queries for data-quality reports and column profiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom import functions as fn
from starloom.operators import profile, quality
from starloom.plans.registry import REGISTRY, Tables

query = REGISTRY.query


def _accounting(t: Tables) -> DataFrame:
    lines = quality.row_accounting(t.lineitem, "lineitem", F.col("l_quantity") > 10, ["l_orderkey", "l_linenumber"])
    orders = quality.row_accounting(t.orders, "orders", F.col("o_orderstatus") != "P", ["o_custkey", "o_orderpriority"])
    customers = quality.row_accounting(t.customer, "customer", F.col("c_acctbal") >= 0, ["c_custkey"])
    return lines.unionByName(orders).unionByName(customers)


def _accounting_sql(table: str, valid: str, keys: str) -> str:
    return f"""
    SELECT '{table}' AS tabla, count(*) AS total, count(DISTINCT ({keys})) FILTER ({valid}) AS validos,
           count(*) - count(*) FILTER ({valid}) AS rechazados,
           count(*) FILTER ({valid}) - count(DISTINCT ({keys})) FILTER ({valid}) AS duplicados
    FROM {table}
    """


ACCOUNTING_SQL = " UNION ALL ".join(
    [
        _accounting_sql("lineitem", "l_quantity > 10", "l_orderkey, l_linenumber"),
        _accounting_sql("orders", "o_orderstatus <> 'P'", "o_custkey, o_orderpriority"),
        _accounting_sql("customer", "c_acctbal >= 0", "c_custkey"),
    ]
)


@query("row_accounting", ACCOUNTING_SQL)
def row_accounting(t: Tables) -> DataFrame:
    return _accounting(t)


@query(
    "grand_total",
    f"""
    SELECT CAST(sum(validos) AS BIGINT) AS total_validos, CAST(sum(rechazados) AS BIGINT) AS total_rechazados,
           CAST(sum(duplicados) AS BIGINT) AS total_duplicados FROM ({ACCOUNTING_SQL})
    """,
)
def grand_total(t: Tables) -> DataFrame:
    return quality.grand_total(_accounting(t), ["validos", "rechazados", "duplicados"])


@query(
    "fk_check",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
    """,
)
def fk_check(t: Tables) -> DataFrame:
    parents = t.customer.where(F.col("c_mktsegment") != "BUILDING")
    return quality.orphans(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey")


@query(
    "unique_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def unique_check(t: Tables) -> DataFrame:
    return quality.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "interval_check",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS valid_from, CAST(l_shipdate AS DATE) AS valid_to
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
    """,
)
def interval_check(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    spans = both.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.to_date("o_orderdate").alias("valid_from"),
        F.to_date("l_shipdate").alias("valid_to"),
    )
    return quality.bad_intervals(spans)


@query(
    "one_current",
    """
    SELECT o_custkey, count(*) FILTER (o_orderdate >= DATE '2001-01-01') AS current_rows FROM orders
    GROUP BY o_custkey HAVING count(*) FILTER (o_orderdate >= DATE '2001-01-01') <> 1
    """,
)
def one_current(t: Tables) -> DataFrame:
    current = (F.to_date("o_orderdate") >= F.lit(dt.date(2001, 1, 1))).alias("es_actual")
    return quality.not_one_current(t.orders.select("o_custkey", current), "o_custkey")


@query(
    "length_check",
    """
    SELECT p_partkey, 'p_name' AS "column", 10 AS max_length, CAST(length(p_name) AS INTEGER) AS length FROM part WHERE length(p_name) > 10
    UNION ALL
    SELECT p_partkey, 'p_brand', 7, CAST(length(p_brand) AS INTEGER) FROM part WHERE length(p_brand) > 7
    """,
)
def length_check(t: Tables) -> DataFrame:
    return quality.too_long(t.part.select("p_partkey", "p_name", "p_brand"), {"p_name": 10, "p_brand": 7})


@query("value_counts", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.documents, "lang")


@query(
    "profile_patterns",
    "SELECT regexp_replace(p_brand, '[0-9]', '#', 'g') AS pattern, count(*) AS n FROM part GROUP BY ALL",
)
def profile_patterns(t: Tables) -> DataFrame:
    return profile.pattern_counts(t.part, "p_brand")


@query(
    "profile_dates",
    """
    SELECT regexp_replace(strftime(l_shipdate, '%Y-%m-%d'), '[0-9]', '#', 'g') AS pattern, count(*) AS n
    FROM lineitem GROUP BY ALL
    """,
)
def profile_dates(t: Tables) -> DataFrame:
    return profile.pattern_counts(t.lineitem.select(F.to_date("l_shipdate").alias("day")), "day")


@query("distinct_values", "SELECT DISTINCT p_type FROM part")
def distinct_values(t: Tables) -> DataFrame:
    return profile.distinct_values(t.part, "p_type")


@query(
    "group_size_histogram",
    """
    SELECT n AS times, count(*) AS values FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    WHERE n > 1 GROUP BY n
    """,
)
def group_size_histogram(t: Tables) -> DataFrame:
    return profile.group_size_histogram(t.lineitem, "l_orderkey")


@query(
    "length_without_dots",
    """
    SELECT length, count(*) AS n FROM (SELECT CAST(length(CAST(CAST(c_acctbal * 100 AS BIGINT) AS VARCHAR)) AS INTEGER) AS length FROM customer)
    GROUP BY length
    """,
)
def length_without_dots(t: Tables) -> DataFrame:
    dotted = F.translate(F.format_number(F.round(F.col("c_acctbal") * 100).cast("bigint"), 0), ",", ".")
    spaced = F.concat(F.lit(" "), dotted)
    return profile.value_counts(t.customer.select(fn.length_without_dots(spaced).alias("length")), "length")


@query(
    "null_token_count",
    """
    SELECT count(*) FILTER (p_size % 6 < 4) AS null_tokens, count(*) AS total FROM part
    """,
)
def null_token_count(t: Tables) -> DataFrame:
    sixth = F.pmod("p_size", F.lit(6))
    text = (
        F.when(sixth == 0, F.lit(None)).when(sixth == 1, F.lit(" ")).when(sixth == 2, F.lit("n/a"))
        .when(sixth == 3, F.lit("null")).when(sixth == 4, F.lit("NULL ")).otherwise(F.col("p_name"))
    )
    return t.part.select(fn.is_null_token(text).alias("token")).agg(
        F.count_if("token").alias("null_tokens"), F.count(F.lit(1)).alias("total")
    )


CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS rows, count({c}) AS present, "
        f"count(*) - count({c}) AS missing, CAST(min({c}) AS VARCHAR) AS smallest, "
        f"CAST(max({c}) AS VARCHAR) AS largest FROM customer"
        for c, kind in CUSTOMER_TYPES.items()
    ),
)
def column_profile(t: Tables) -> DataFrame:
    return profile.column_profile(t.customer)


@query(
    "grade_by_result",
    """
    SELECT l_returnflag AS resultado, min(l_quantity) AS smallest, max(l_quantity) AS largest, count(*) AS n
    FROM lineitem GROUP BY l_returnflag
    """,
)
def grade_by_result(t: Tables) -> DataFrame:
    return profile.extremes(t.lineitem.withColumnRenamed("l_returnflag", "resultado"), "resultado", "l_quantity")
