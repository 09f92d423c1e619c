"""Queries for state that deltas are merged into, canonical ids, snapshots and histories."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import digit_mask
from starloom.operators import attempts, constraints, groups, repoint, sketches, snapshot
from starloom.operators.dedupe import KEPT_ID, REPEATED_ID, duplicate_map
from starloom.plans import queries_dedupe as dedupe
from starloom.plans.registry import REGISTRY, Tables
from starloom.session import materialize

query = REGISTRY.query

# Orders of one customer with one priority stand for the records of one person.
GROUP = ["o_custkey", "o_orderpriority"]
ARRIVALS = (dt.date(1994, 1, 1), dt.date(1996, 1, 1), dt.date(1998, 1, 1))
GROUPS_SQL = "SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS kept FROM orders"


def arrivals(t: Tables) -> list[DataFrame]:
    """Pairs of group and order in the order in which they arrive."""
    pairs = groups.group_pairs(t.orders.select(*GROUP, "o_orderkey", "o_orderdate"), [*GROUP, "o_orderdate"], "o_orderkey")
    bounds = [None, *ARRIVALS, None]
    parts = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        rows = pairs if low is None else pairs.where(F.col("o_orderdate") >= F.lit(low))
        rows = rows if high is None else rows.where(F.col("o_orderdate") < F.lit(high))
        parts.append(rows.select(*GROUP, "o_orderkey"))
    return parts


def merged_state(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, repeated ids of groups and map after all arrivals, one merged after the other; and the last changes."""
    first, *later = arrivals(t)
    pairs = materialize(first.distinct())
    repeated = materialize(groups.repeated_in_groups(pairs, GROUP, "o_orderkey"))
    id_map = repeated.select(REPEATED_ID, KEPT_ID)
    changes = id_map.select(F.col(REPEATED_ID).alias("id"), F.col(REPEATED_ID).alias(groups.BEFORE), F.col(KEPT_ID).alias(groups.AFTER))
    for delta in later:
        found = groups.merge_groups(pairs, delta, GROUP, "o_orderkey")
        touched = materialize(delta.select(*GROUP).distinct())
        update = groups.update_map(repeated, found.repeated, touched, GROUP)
        changes = materialize(update.changes(id_map))
        id_map = materialize(update.apply(id_map))
        repeated = materialize(repeated.join(touched, GROUP, "left_anti").unionByName(found.repeated))
        pairs = pairs.unionByName(found.new_pairs)
    return pairs, id_map, changes


@query("group_state_map", f"SELECT id AS id_repetido, kept AS id_tomado FROM ({GROUPS_SQL}) WHERE id <> kept")
def group_state_map(t: Tables) -> DataFrame:
    """The duplicate map after four deliveries, each merged into the state of those before."""
    return merged_state(t)[1]


@query(
    "group_state_changes",
    f"""
    WITH b AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS kept
               FROM orders WHERE o_orderdate < DATE '{ARRIVALS[-1]}'), a AS ({GROUPS_SQL})
    SELECT a.id, coalesce(b.kept, a.id) AS antes, a.kept AS despues FROM a LEFT JOIN b USING (id) WHERE coalesce(b.kept, a.id) <> a.kept
    """,
)
def group_state_changes(t: Tables) -> DataFrame:
    """Canonical ids that the last delivery changed: smaller ids that came later, and new repeated ones."""
    return merged_state(t)[2]


@query(
    "canonical_changes",
    f"""
    WITH b AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS kept
               FROM orders WHERE o_orderdate < DATE '{ARRIVALS[1]}'), a AS ({GROUPS_SQL})
    SELECT a.id, coalesce(b.kept, a.id) AS antes, a.kept AS despues FROM a LEFT JOIN b USING (id) WHERE coalesce(b.kept, a.id) <> a.kept
    """,
)
def canonical_changes(t: Tables) -> DataFrame:
    """The difference of the duplicate maps before and after a delivery."""
    earlier = t.orders.where(F.col("o_orderdate") < F.lit(ARRIVALS[1]))
    return groups.canonical_changes(duplicate_map(earlier, GROUP, "o_orderkey"), duplicate_map(t.orders, GROUP, "o_orderkey"))


@query(
    "canonical_chains",
    """
    WITH RECURSIVE links AS (
      SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS kept FROM orders),
    walk AS (
      SELECT id, kept FROM links WHERE kept IS NOT NULL
      UNION ALL SELECT w.id, l.kept FROM walk w JOIN links l ON l.id = w.kept WHERE l.kept IS NOT NULL)
    SELECT id AS id_repetido, min(kept) AS id_tomado FROM walk GROUP BY id
    """,
)
def canonical_chains(t: Tables) -> DataFrame:
    """Orders that stand for the customer's order before them, followed to the end of the chain."""
    same = t.orders.select(F.col("o_custkey"), F.col("o_orderkey").alias(REPEATED_ID))
    earlier = F.lag(REPEATED_ID).over(Window.partitionBy("o_custkey").orderBy(REPEATED_ID))
    return groups.compact_chains(same.withColumn(KEPT_ID, earlier).dropna().select(REPEATED_ID, KEPT_ID))


@query(
    "repointed_orders",
    """
    WITH m AS (SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS kept FROM customer),
    h AS (SELECT o_orderkey, kept, o_orderpriority, o_custkey FROM orders JOIN m ON id = o_custkey WHERE id <> kept),
    f AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = h.kept AND o.o_orderpriority = h.o_orderpriority)
          QUALIFY row_number() OVER (PARTITION BY kept, o_orderpriority ORDER BY o_orderkey) = 1)
    SELECT o_orderkey, kept AS o_custkey, o_orderpriority, TRUE AS movida FROM f
    UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, FALSE FROM h WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)
    """,
)
def repointed_orders(t: Tables) -> DataFrame:
    """Orders of absorbed customers under the canonical customer, where its key is free."""
    merged = duplicate_map(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey")
    changed = merged.select(F.col(REPEATED_ID).alias("clave"), F.col(KEPT_ID).alias("clave_nueva"))
    fact = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    found = repoint.repoint(fact, changed, "o_custkey", ["o_custkey", "o_orderpriority"], "o_orderkey")
    return found.moved.withColumn("movida", F.lit(True)).unionByName(found.blocked.withColumn("movida", F.lit(False)))


OLD_STATE, NEW_STATE = dt.date(1997, 1, 1), dt.date(1993, 1, 1)
SNAPSHOT_SQL = f"""
    WITH b AS (SELECT o_orderkey, 'O' AS s, o_orderpriority AS p FROM orders WHERE o_orderdate < DATE '{OLD_STATE}'),
    a AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderdate >= DATE '{NEW_STATE}')
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'insertada' WHEN a.o_orderkey IS NULL THEN 'eliminada'
           WHEN a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p THEN 'modificada' ELSE 'igual' END AS cambio
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
"""


def order_changes(t: Tables) -> DataFrame:
    """Two versions of staged orders: an early one where all are open, and a later one without the oldest."""
    columns = ["o_orderstatus", "o_orderpriority"]
    before = t.orders.where(F.col("o_orderdate") < F.lit(OLD_STATE)).withColumn("o_orderstatus", F.lit("O"))
    after = t.orders.where(F.col("o_orderdate") >= F.lit(NEW_STATE))
    return snapshot.snapshot_changes(before, after, ["o_orderkey"], columns)


@query("snapshot_changes", SNAPSHOT_SQL)
def snapshot_changes(t: Tables) -> DataFrame:
    return order_changes(t)


@query("snapshot_counts", f"SELECT cambio, count(*) AS claves FROM ({SNAPSHOT_SQL}) GROUP BY cambio")
def snapshot_counts(t: Tables) -> DataFrame:
    return snapshot.change_counts(order_changes(t))


@query(
    "closed_versions",
    f"""
    SELECT c_custkey, c_name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '{NEW_STATE}') THEN DATE '{OLD_STATE}' END AS valid_to,
           c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '{NEW_STATE}') AS es_actual
    FROM customer
    """,
)
def closed_versions(t: Tables) -> DataFrame:
    """Customers as a dimension, with the versions of those closed who had the oldest orders."""
    dimension = t.customer.select("c_custkey", "c_name", F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("es_actual"))
    gone = t.orders.where(F.col("o_orderdate") < F.lit(NEW_STATE)).select(F.col("o_custkey").alias("c_custkey"))
    return repoint.close_versions(dimension, gone, "c_custkey", OLD_STATE)


@query(
    "attempt_history_counts",
    f"""
    SELECT (SELECT count(*) FROM ({REGISTRY.sql["attempt_history_filter"]})) AS aceptados,
           (SELECT count(*) FROM lineitem WHERE l_shipdate >= DATE '{dedupe.HISTORY_CUT}')
           - (SELECT count(*) FROM ({REGISTRY.sql["attempt_history_filter"]})) AS rechazados
    """,
)
def attempt_history_counts(t: Tables) -> DataFrame:
    """Attempts that the history lets in, and those it turns away."""
    offered = t.lineitem.where(F.col("l_shipdate") >= F.lit(dedupe.HISTORY_CUT))
    return attempts.history_counts(offered, dedupe.attempt_history_filter(t))


BATCH = dt.date(1998, 1, 1)
MOST_PRICE = 300_000


@query(
    "constraint_violations",
    f"""
    WITH b AS (SELECT * FROM orders WHERE o_orderdate >= DATE '{BATCH}')
    SELECT 'orders' AS tabla, 'unica(o_custkey, o_orderpriority)' AS regla, o_custkey || ', ' || o_orderpriority AS clave, count(*) AS filas
    FROM orders WHERE o_orderstatus = 'O' AND EXISTS (
      SELECT 1 FROM b WHERE b.o_custkey = orders.o_custkey AND b.o_orderpriority = orders.o_orderpriority AND b.o_orderstatus = 'O')
    GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'orders', 'existe(o_custkey en customer)', CAST(o_custkey AS VARCHAR), count(*) FROM b
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY ALL
    UNION ALL SELECT 'orders', 'cumple(o_totalprice <= {MOST_PRICE})', CAST(o_orderkey AS VARCHAR), count(*) FROM b WHERE o_totalprice > {MOST_PRICE} GROUP BY ALL
    """,
)
def constraint_violations(t: Tables) -> DataFrame:
    """What a batch of orders would break: open ones of a customer repeated, customers in debt, too high prices."""
    batch = t.orders.where(F.col("o_orderdate") >= F.lit(BATCH))
    stored = {"orders": t.orders, "customer": t.customer.where("c_acctbal >= 0")}
    rules = [
        constraints.Unique("orders", ("o_custkey", "o_orderpriority"), "o_orderstatus = 'O'"),
        constraints.References("orders", ("o_custkey",), "customer", ("c_custkey",)),
        constraints.Holds("orders", ("o_orderkey",), f"o_totalprice <= {MOST_PRICE}"),
        constraints.Holds("customer", ("c_custkey",), "false"),  # not touched, so not looked at
    ]
    empty = t.spark.createDataFrame([], constraints.VIOLATIONS)
    return constraints.violations(rules, {"orders": batch}, lambda table, keys: stored[table], empty)


@query(
    "profile_sketches",
    """
    SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS "column", count(*) AS rows, 0 AS missing,
           TRUE AS distinct_close, TRUE AS quantiles_close, TRUE AS patterns_close
    FROM orders GROUP BY 1
    """,
)
def profile_sketches(t: Tables) -> DataFrame:
    """Sketches of each year's orders, merged; whether they are as close to the exact figures as they promise."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    bounds = [dt.date(1900, 1, 1), *ARRIVALS, dt.date(3000, 1, 1)]
    parts = [
        sketches.sketch_columns(t.orders.where(F.col("o_orderdate").between(F.lit(low), F.date_sub(F.lit(high), 1))), columns)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True)
    ]
    found = materialize(sketches.estimates(sketches.merge_sketches(reduce(DataFrame.unionByName, parts))))
    numbers = {c for c, kind in t.orders.dtypes if kind != "string"}
    checked = []
    for name in columns:
        measure = F.col(name).cast("double") if name in numbers else F.length(name).cast("double")
        values = t.orders.select(F.col(name).alias("v"), measure.alias("m"), digit_mask(F.col(name).cast("string")).alias("p"))
        told = found.where(F.col("column") == name).first()
        # The share of rows below a quantile, and up to it, has the share asked for within the error.
        near = [
            (F.avg((F.col("m") < x).cast("int")) <= q + sketches.RANK_ERROR) & (F.avg((F.col("m") <= x).cast("int")) >= q - sketches.RANK_ERROR)
            for q, x in zip(sketches.QUANTILES, told.quantiles, strict=True)
        ]
        counted = [F.abs(F.count_if(F.col("p") == p.pattern) - p.rows) <= sketches.PATTERN_ERROR * F.count("p") for p in told.patterns]
        exact = F.countDistinct("v")
        checked.append(
            values.agg(
                (F.abs(exact - told.distinct) <= sketches.DISTINCT_ERROR * exact).alias("distinct_close"),
                reduce(and_, near).alias("quantiles_close"),
                reduce(and_, counted).alias("patterns_close"),
            ).select(F.lit(name).alias("column"), F.lit(told.rows).alias("rows"), F.lit(told.missing).alias("missing"), "*")
        )
    return reduce(DataFrame.unionByName, checked)
