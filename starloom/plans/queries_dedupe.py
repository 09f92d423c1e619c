"""Queries for deduplication, identity resolution and attempt rules.

Customers stand for students, orders for enrollments and line items for exams:
customers of one nation and segment with about the same balance count as one
person, and ``l_returnflag = 'A'`` as a passed exam.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators import attempts, dedupe, profile
from starloom.operators.cascade import (
    Cascade,
    CascadeColumns,
    enrollment_duplicates,
    identity_maps,
    resolve_identities,
)
from starloom.operators.joins import drop_matching, keep_matching, split_matching
from starloom.plans.registry import REGISTRY, Tables
from starloom.session import materialize

query = REGISTRY.query

LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag"]


def lines(t: Tables) -> DataFrame:
    return t.lineitem.select(*LINE_COLUMNS).withColumn("l_shipdate", F.to_date("l_shipdate"))


def customers(t: Tables) -> DataFrame:
    """Customers with the columns that identify a person."""
    return t.customer.withColumn("balance_band", F.floor(F.col("c_acctbal") / 10).cast("bigint"))


PERSON = ["c_nationkey", "c_mktsegment", "balance_band"]


def orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"))


COLUMNS = CascadeColumns(
    person="o_custkey", identity=tuple(PERSON), enrollment="o_orderkey", offering="o_orderpriority"
)
ENROLLMENT = ["o_custkey", "o_orderpriority"]


def people(t: Tables) -> DataFrame:
    return customers(t).withColumnRenamed("c_custkey", "o_custkey")


def person_map(t: Tables) -> DataFrame:
    return materialize(dedupe.duplicate_map(people(t), PERSON, "o_custkey"))


def raw_exams(t: Tables) -> DataFrame:
    """Line items with the order they belong to and, for later, the one they came with."""
    return lines(t).select(
        F.col("l_orderkey").alias("source_order"),
        F.col("l_orderkey").alias("o_orderkey"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        (F.col("l_returnflag") == "A").alias("passed"),
    )


def cascade(t: Tables) -> Cascade:
    return resolve_identities(people(t), orders(t), raw_exams(t), COLUMNS)


EXAM_TIE = ["source_order", "l_linenumber", "l_partkey", "l_suppkey"]

# The same steps in SQL.
PERSON_SQL = """
    people AS (SELECT *, CAST(floor(c_acctbal / 10) AS BIGINT) AS balance_band FROM customer),
    canon AS (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, balance_band) AS kept FROM people),
    person_map AS (SELECT c_custkey AS id_repetido, kept AS id_tomado FROM canon WHERE c_custkey <> kept)
"""
ORDER_SQL = f"""
    {PERSON_SQL},
    remapped AS (
      SELECT o_orderkey, coalesce(id_tomado, o_custkey) AS o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate
      FROM orders LEFT JOIN person_map ON id_repetido = o_custkey),
    merged AS (
      SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS kept FROM remapped
      WHERE o_custkey IN (SELECT id_tomado FROM person_map)),
    order_map AS (SELECT o_orderkey AS id_repetido, kept AS id_tomado FROM merged WHERE o_orderkey <> kept),
    clean_orders AS (SELECT * FROM remapped WHERE o_orderkey NOT IN (SELECT id_repetido FROM order_map))
"""
EXAM_SQL = f"""
    {ORDER_SQL},
    exams AS (
      SELECT l_orderkey AS source_order, coalesce(id_tomado, l_orderkey) AS o_orderkey, l_linenumber, l_partkey,
             l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_returnflag = 'A' AS passed
      FROM lineitem LEFT JOIN order_map ON id_repetido = l_orderkey),
    touched AS (SELECT id_repetido AS id FROM order_map UNION SELECT id_tomado FROM order_map),
    owned AS (
      SELECT e.*, o_custkey, o_orderpriority FROM exams e JOIN clean_orders USING (o_orderkey)
      WHERE o_orderkey IN (SELECT id FROM touched)),
    daily AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, l_shipdate
                       ORDER BY source_order, l_linenumber, l_partkey, l_suppkey) AS rn FROM owned) WHERE rn = 1),
    chain AS (
      SELECT *, max(CAST(passed AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             row_number() OVER w AS number
      FROM daily WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY l_shipdate)),
    ruled AS (SELECT * FROM chain WHERE coalesce(before, 0) = 0)
"""


def _dedupe_sql(direction: str) -> str:
    return f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_quantity, l_returnflag
    FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate {direction}, l_partkey {direction}, l_suppkey {direction}) = 1
    """


@query("dedupe_first", _dedupe_sql("ASC"))
def dedupe_first(t: Tables) -> DataFrame:
    return dedupe.keep_one(lines(t), ["l_orderkey", "l_linenumber"], LINE_ORDER)


@query("dedupe_last", _dedupe_sql("DESC"))
def dedupe_last(t: Tables) -> DataFrame:
    return dedupe.keep_one(lines(t), ["l_orderkey", "l_linenumber"], LINE_ORDER, keep="last")


@query("detect_duplicates_map", f"WITH {PERSON_SQL} SELECT id_repetido, id_tomado FROM person_map")
def detect_duplicates_map(t: Tables) -> DataFrame:
    return dedupe.duplicate_map(customers(t), PERSON, "c_custkey")


@query(
    "detect_duplicates_clean",
    f"WITH {PERSON_SQL} SELECT c_custkey, c_name, c_nationkey, c_mktsegment, balance_band FROM canon WHERE c_custkey = kept",
)
def detect_duplicates_clean(t: Tables) -> DataFrame:
    clean = dedupe.drop_duplicates_of(customers(t), PERSON, "c_custkey")
    return clean.select("c_custkey", "c_name", *PERSON)


@query(
    "smallest_id_per_group",
    """
    SELECT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, min(o_orderkey) AS id_tomado
    FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)
    """,
)
def smallest_id_per_group(t: Tables) -> DataFrame:
    return dedupe.smallest_ids(orders(t), ["o_custkey", "o_orderdate"], "o_orderkey")


@query("identity_remap", f"WITH {ORDER_SQL} SELECT * FROM remapped")
def identity_remap(t: Tables) -> DataFrame:
    return dedupe.remap(orders(t), person_map(t), "o_custkey")


@query(
    "identity_remap_count",
    f"WITH {PERSON_SQL} SELECT count(*) AS remapped FROM orders WHERE o_custkey IN (SELECT id_repetido FROM person_map)",
)
def identity_remap_count(t: Tables) -> DataFrame:
    return dedupe.count_remapped(orders(t), person_map(t), "o_custkey")


@query("enrollment_map_merged", f"WITH {ORDER_SQL} SELECT id_repetido, id_tomado FROM order_map")
def enrollment_map_merged(t: Tables) -> DataFrame:
    return identity_maps(people(t), orders(t), COLUMNS)[1]


@query(
    "enrollment_map_all",
    f"""
    WITH {ORDER_SQL}, every AS (
      SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS kept FROM remapped)
    SELECT o_orderkey AS id_repetido, kept AS id_tomado FROM every WHERE o_orderkey <> kept
    """,
)
def enrollment_map_all(t: Tables) -> DataFrame:
    merges = person_map(t)
    canonical = dedupe.remap(orders(t), merges, "o_custkey")
    return enrollment_duplicates(canonical, merges, COLUMNS, scope="all")


@query("identity_cascade_enrollments", f"WITH {ORDER_SQL} SELECT * FROM clean_orders")
def identity_cascade_enrollments(t: Tables) -> DataFrame:
    return cascade(t).enrollments


@query("identity_cascade_exams", f"WITH {EXAM_SQL} SELECT * FROM exams")
def identity_cascade_exams(t: Tables) -> DataFrame:
    return cascade(t).exams


@query(
    "attempt_consolidation",
    f"""
    WITH {EXAM_SQL}
    SELECT source_order, o_orderkey, CAST(number AS INTEGER) AS l_linenumber, l_partkey, l_suppkey, l_shipdate, passed FROM ruled
    UNION ALL
    SELECT * FROM exams WHERE o_orderkey NOT IN (SELECT id FROM touched)
    """,
)
def attempt_consolidation(t: Tables) -> DataFrame:
    merged = cascade(t)
    return attempts.consolidate_attempts(
        merged.exams,
        merged.enrollments,
        merged.enrollment_map,
        enrollment_id="o_orderkey",
        group=ENROLLMENT,
        date="l_shipdate",
        tie=EXAM_TIE,
        passed="passed",
        attempt="l_linenumber",
    )


@query(
    "attempt_consolidation_counts",
    f"""
    WITH {EXAM_SQL}
    SELECT count(*) AS afectados, count(DISTINCT (o_custkey, o_orderpriority)) AS grupos,
           count(*) - (SELECT count(*) FROM ruled) AS eliminados
    FROM owned
    """,
)
def attempt_consolidation_counts(t: Tables) -> DataFrame:
    merged = cascade(t)
    return attempts.consolidation_counts(
        merged.exams,
        merged.enrollments,
        merged.enrollment_map,
        enrollment_id="o_orderkey",
        group=ENROLLMENT,
        date="l_shipdate",
        tie=EXAM_TIE,
        passed="passed",
    )


@query(
    "attempt_rule",
    """
    WITH daily AS (
      SELECT l_partkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_returnflag = 'A' AS passed
      FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1),
    chain AS (
      SELECT *, max(CAST(passed AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             CAST(row_number() OVER w AS INTEGER) AS attempt
      FROM daily WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate))
    SELECT * EXCLUDE (before) FROM chain WHERE coalesce(before, 0) = 0
    """,
)
def attempt_rule(t: Tables) -> DataFrame:
    rows = lines(t).select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_returnflag") == "A").alias("passed")
    )
    return attempts.apply_attempt_rule(
        rows, ["l_partkey"], "l_shipdate", ["l_orderkey", "l_linenumber", "l_suppkey"], "passed", "attempt"
    )


HISTORY_CUT = dt.date(1998, 7, 1)
PAIR = ["l_partkey", "l_suppkey"]


def _history(t: Tables) -> DataFrame:
    passed = ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)).alias("passed")
    return lines(t).where(F.col("l_shipdate") < F.lit(HISTORY_CUT)).select(*PAIR, passed)


@query(
    "attempt_history",
    """
    SELECT l_partkey, l_suppkey, count(*) AS prior_attempts,
           bool_or(l_returnflag = 'A' AND l_linenumber = 1) AS already_passed
    FROM lineitem WHERE l_shipdate < DATE '1998-07-01' GROUP BY l_partkey, l_suppkey
    """,
)
def attempt_history(t: Tables) -> DataFrame:
    return attempts.attempt_history(_history(t), PAIR, "passed")


@query(
    "attempt_history_filter",
    """
    WITH history AS (
      SELECT l_partkey, l_suppkey, count(*) AS n, bool_or(l_returnflag = 'A' AND l_linenumber = 1) AS done
      FROM lineitem WHERE l_shipdate < DATE '1998-07-01' GROUP BY l_partkey, l_suppkey),
    open AS (
      SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_linenumber,
             l_returnflag = 'A' AS passed, coalesce(n, 0) AS n
      FROM lineitem LEFT JOIN history USING (l_partkey, l_suppkey)
      WHERE l_shipdate >= DATE '1998-07-01' AND NOT coalesce(done, FALSE)),
    daily AS (
      SELECT * FROM open
      QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) = 1),
    chain AS (
      SELECT *, max(CAST(passed AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             row_number() OVER w AS position
      FROM daily WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate))
    SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, CAST(n + position AS INTEGER) AS l_linenumber, passed
    FROM chain WHERE coalesce(before, 0) = 0
    """,
)
def attempt_history_filter(t: Tables) -> DataFrame:
    new = lines(t).where(F.col("l_shipdate") >= F.lit(HISTORY_CUT)).select(
        "l_orderkey", *PAIR, "l_shipdate", "l_linenumber", (F.col("l_returnflag") == "A").alias("passed")
    )
    return attempts.filter_by_history(
        new,
        _history(t),
        keys=PAIR,
        date="l_shipdate",
        tie=["l_orderkey", "l_linenumber"],
        passed="passed",
        attempt="l_linenumber",
    )


@query(
    "semi_lookup",
    """
    SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)
    """,
)
def semi_lookup(t: Tables) -> DataFrame:
    wanted = t.lineitem.where(F.col("l_quantity") >= 45).select(F.col("l_orderkey").alias("o_orderkey"))
    return keep_matching(orders(t), wanted, ["o_orderkey"])


@query(
    "anti_filter",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    """,
)
def anti_filter(t: Tables) -> DataFrame:
    seen = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return drop_matching(t.customer.select("c_custkey", "c_name"), seen, ["c_custkey"])


@query(
    "pair_lookup",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_quantity, l_returnflag
    FROM lineitem
    WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50)
    """,
)
def pair_lookup(t: Tables) -> DataFrame:
    return keep_matching(lines(t), t.lineitem.where(F.col("l_quantity") == 50), PAIR)


@query(
    "complement_split",
    f"""
    WITH {PERSON_SQL}
    SELECT o_orderkey, o_custkey IN (SELECT id_repetido FROM person_map UNION SELECT id_tomado FROM person_map) AS touched
    FROM orders
    """,
)
def complement_split(t: Tables) -> DataFrame:
    touched, rest = split_matching(orders(t), attempts.touched_ids(person_map(t), "o_custkey"), ["o_custkey"])
    both = touched.withColumn("touched", F.lit(True)).unionByName(rest.withColumn("touched", F.lit(False)))
    return both.select("o_orderkey", "touched")


@query(
    "key_set_union",
    f"WITH {PERSON_SQL} SELECT id_repetido AS c_custkey FROM person_map UNION SELECT id_tomado FROM person_map",
)
def key_set_union(t: Tables) -> DataFrame:
    return attempts.touched_ids(person_map(t), "c_custkey")


@query("distinct_pairs", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_pairs(t: Tables) -> DataFrame:
    return profile.distinct_values(t.lineitem, *PAIR)
