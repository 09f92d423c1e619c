"""Queries for dimensions, facts, merges, slowly changing dimensions and deltas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom import functions as fn
from starloom.operators import dimensions, facts, keys, merge, quality, scd, watermark
from starloom.operators.dedupe import keep_one
from starloom.operators.joins import flatten_chain, missing_references, skew_safe_join
from starloom.plans.queries_cleaning import KEY_SQL, MONTHS_SQL, PERIOD_SQL
from starloom.plans.registry import REGISTRY, Tables

query = REGISTRY.query

AS_OF = dt.date(2025, 1, 1)


@query(
    "dim_date",
    f"""
    WITH d AS (SELECT CAST(o_orderdate AS DATE) AS fecha FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem
               UNION SELECT CAST(ts AS DATE) FROM events)
    SELECT {KEY_SQL.format("fecha")} AS "tiempoSKey", fecha, CAST(day(fecha) AS INTEGER) AS dia,
           {MONTHS_SQL.format("fecha")} AS mes, CAST(year(fecha) AS INTEGER) AS ano,
           {PERIOD_SQL.format("fecha")} AS "periodoAcademico", FALSE AS "esFeriado"
    FROM d WHERE fecha IS NOT NULL
    """,
)
def dim_date(t: Tables) -> DataFrame:
    return dimensions.calendar_dimension(
        dimensions.distinct_dates((t.orders, "o_orderdate"), (t.lineitem, "l_shipdate"), (t.events, "ts"))
    )


@query(
    "dim_flatten_chain",
    """
    SELECT s_suppkey, s_name, s_acctbal, n_name, r_name, DATE '2025-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to,
           TRUE AS es_actual
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20
    LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'
    """,
)
def dim_flatten_chain(t: Tables) -> DataFrame:
    nation = t.nation.where(F.col("n_nationkey") < 20).withColumnRenamed("n_nationkey", "s_nationkey")
    region = t.region.where(F.col("r_name") != "ASIA").withColumnRenamed("r_regionkey", "n_regionkey")
    flat = flatten_chain(t.supplier, [(nation, "s_nationkey"), (region, "n_regionkey")])
    versioned = dimensions.versioned(flat, AS_OF)
    columns = ["s_suppkey", "s_name", "s_acctbal", "n_name", "r_name", "valid_from", "valid_to", "es_actual"]
    return dimensions.finish_dimension(versioned, columns, "s_suppkey", ["s_name"])


@query(
    "dim_left_lookup",
    """
    SELECT c_custkey AS idalumno, c_name AS nombre, n_name AS "nombrePrograma", FALSE AS "egresoCarrera",
           CAST(NULL AS INTEGER) AS "anioEgreso", DATE '2025-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to,
           TRUE AS es_actual
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2
    """,
)
def dim_left_lookup(t: Tables) -> DataFrame:
    nation = t.nation.where(F.col("n_regionkey") != 2).withColumnRenamed("n_nationkey", "c_nationkey")
    named = skew_safe_join(t.customer, nation, ["c_nationkey"]).withColumnsRenamed(
        {"c_custkey": "idalumno", "c_name": "nombre", "n_name": "nombrePrograma"}
    )
    full = dimensions.versioned(
        named, AS_OF, egresoCarrera=F.lit(False), anioEgreso=F.lit(None).cast("int")
    )
    columns = ["idalumno", "nombre", "nombrePrograma", "egresoCarrera", "anioEgreso", "valid_from", "valid_to", "es_actual"]
    return dimensions.finish_dimension(full, columns, "idalumno", ["nombre"])


@query(
    "missing_references",
    """
    SELECT 'nation' AS branch, count(*) FILTER (n_name IS NULL) AS missing_rows
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20
    UNION ALL
    SELECT 'region', count(*) FILTER (r_name IS NULL)
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20
    LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'
    """,
)
def missing_reference_counts(t: Tables) -> DataFrame:
    nation = t.nation.where(F.col("n_nationkey") < 20).withColumnRenamed("n_nationkey", "s_nationkey")
    region = t.region.where(F.col("r_name") != "ASIA").withColumnRenamed("r_regionkey", "n_regionkey")
    flat = flatten_chain(t.supplier, [(nation, "s_nationkey"), (region, "n_regionkey")])
    return missing_references(flat, {"nation": "n_name", "region": "r_name"})


@query(
    "surrogate_keys",
    """
    SELECT row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) + 99 AS sk, c_nationkey, c_custkey, c_name
    FROM customer
    """,
)
def surrogate_keys(t: Tables) -> DataFrame:
    ordered = t.customer.select((-F.col("c_nationkey")).alias("_rank"), "c_nationkey", "c_custkey", "c_name")
    return keys.assign_surrogate_keys(ordered, "sk", ["_rank", "c_custkey"], start=100).drop("_rank")


@query(
    "surrogate_keys_lines",
    """
    SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sk,
           CAST(l_shipdate AS DATE) AS l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey
    FROM lineitem
    """,
)
def surrogate_keys_lines(t: Tables) -> DataFrame:
    columns = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = t.lineitem.select(*columns).withColumn("l_shipdate", F.to_date("l_shipdate"))
    return keys.assign_surrogate_keys(rows, "sk", columns)


@query(
    "assign_in_turn",
    """
    WITH holders AS (
      SELECT c_nationkey AS g, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS turn,
             count(*) OVER (PARTITION BY c_nationkey) AS n
      FROM customer WHERE c_nationkey < 20),
    items AS (
      SELECT event_id, CAST(user_id % 25 AS INTEGER) AS g,
             row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) - 1 AS place
      FROM events)
    SELECT event_id, items.g AS c_nationkey, c_custkey
    FROM items LEFT JOIN (SELECT DISTINCT g, n FROM holders) s ON s.g = items.g
    LEFT JOIN holders h ON h.g = items.g AND h.turn = place % s.n
    """,
)
def assign_in_turn(t: Tables) -> DataFrame:
    items = t.events.select("event_id", F.pmod("user_id", F.lit(25)).cast("int").alias("c_nationkey"))
    holders = t.customer.where(F.col("c_nationkey") < 20).select("c_nationkey", "c_custkey")
    return keys.assign_in_turn(items, holders, ["c_nationkey"], "event_id", "c_custkey")


@query("table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS tabla, count(*) AS filas FROM {n}" for n in ("customer", "orders", "lineitem", "events")
))
def table_counts(t: Tables) -> DataFrame:
    return quality.row_counts({n: getattr(t, n) for n in ("customer", "orders", "lineitem", "events")})


def _student_map(t: Tables) -> DataFrame:
    """Customer versions; those with a debt are closed and have no current row."""
    versions = t.customer.select(
        F.col("c_custkey").alias("idalumno"),
        (F.col("c_custkey") + 1000).alias("alumnoSKey"),
        (F.col("c_acctbal") >= 0).alias("es_actual"),
    )
    return keys.current_key_map(versions, "idalumno", "alumnoSKey")


def _offering_map(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size") > 5).select(
        F.col("p_partkey").alias("idDictado"), (F.col("p_partkey") + 5000).alias("dictadoSKey")
    )


@query("current_key_map", 'SELECT c_custkey AS idalumno, c_custkey + 1000 AS "alumnoSKey" FROM customer WHERE c_acctbal >= 0')
def current_key_map(t: Tables) -> DataFrame:
    return _student_map(t)


STUDENT_SQL = 'students AS (SELECT c_custkey AS idalumno, c_custkey + 1000 AS "alumnoSKey" FROM customer WHERE c_acctbal >= 0)'
OFFERING_SQL = 'offerings AS (SELECT p_partkey AS "idDictado", p_partkey + 5000 AS "dictadoSKey" FROM part WHERE p_size > 5)'


def _enrollment_keys(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderpriority",
        F.to_date("o_orderdate").alias("fecha"),
        F.when(F.col("o_orderstatus") == "F", "Abandonada").otherwise("Activa").alias("estado"),
    ).withColumn("tiempoSKey", fn.date_key(F.col("fecha")))
    return facts.resolve_keys(rows, [facts.KeyLookup("o_custkey", _student_map(t), "idalumno", "alumnoSKey")])


@query(
    "fact_enrollment",
    f"""
    WITH {STUDENT_SQL}
    SELECT "alumnoSKey", {KEY_SQL.format("o_orderdate")} AS "tiempoSKey", o_orderpriority AS dictado,
           CASE WHEN o_orderstatus = 'F' THEN 'Abandonada' ELSE 'Activa' END AS estado, o_orderstatus = 'F' AS abandono
    FROM orders JOIN students ON idalumno = o_custkey
    QUALIFY row_number() OVER (PARTITION BY "alumnoSKey", o_orderpriority ORDER BY o_orderkey DESC) = 1
    """,
)
def fact_enrollment(t: Tables) -> DataFrame:
    found = facts.with_all_keys(_enrollment_keys(t), ["alumnoSKey", "tiempoSKey"])
    latest = keep_one(found, ["alumnoSKey", "o_orderpriority"], ["o_orderkey"], keep="last")
    return latest.select(
        "alumnoSKey",
        "tiempoSKey",
        F.col("o_orderpriority").alias("dictado"),
        "estado",
        fn.matches_any(F.col("estado"), "abandonada", "abandonado", "abandono", "baja").alias("abandono"),
    )


@query("fact_enrollment_rejects", f"WITH {STUDENT_SQL} SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT idalumno FROM students)")
def fact_enrollment_rejects(t: Tables) -> DataFrame:
    return facts.unresolved(_enrollment_keys(t), ["alumnoSKey", "tiempoSKey"]).select("o_orderkey", "o_custkey")


@query(
    "fact_exam",
    f"""
    WITH {STUDENT_SQL}, {OFFERING_SQL}
    SELECT "alumnoSKey", {KEY_SQL.format("l_shipdate")} AS "tiempoSKey", "dictadoSKey",
           CAST(CAST(l_quantity / 5 AS DECIMAL(4, 2)) AS DOUBLE) AS nota, l_linenumber AS "nroIntentos", l_returnflag = 'A' AS aprobado
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN students ON idalumno = o_custkey
    JOIN offerings ON "idDictado" = l_partkey
    QUALIFY row_number() OVER (PARTITION BY "alumnoSKey", "dictadoSKey", l_linenumber
                               ORDER BY l_shipdate DESC, l_orderkey DESC, l_suppkey DESC) = 1
    """,
)
def fact_exam(t: Tables) -> DataFrame:
    exams = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").alias("nroIntentos"),
        F.to_date("l_shipdate").alias("fecha"),
        (F.col("l_quantity") / 5).cast("decimal(4,2)").cast("double").alias("nota"),
        fn.matches_any(F.col("l_returnflag"), "a").alias("aprobado"),
    )
    owned = skew_safe_join(exams, t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"])
    resolved = facts.resolve_keys(
        owned.withColumn("tiempoSKey", fn.date_key(F.col("fecha"))),
        [
            facts.KeyLookup("o_custkey", _student_map(t), "idalumno", "alumnoSKey"),
            facts.KeyLookup("l_partkey", _offering_map(t), "idDictado", "dictadoSKey"),
        ],
    )
    found = facts.with_all_keys(resolved, ["alumnoSKey", "dictadoSKey", "tiempoSKey"])
    last = keep_one(found, ["alumnoSKey", "dictadoSKey", "nroIntentos"], ["fecha", "o_orderkey", "l_suppkey"], keep="last")
    return last.select("alumnoSKey", "tiempoSKey", "dictadoSKey", "nota", "nroIntentos", "aprobado")


@query(
    "fact_evaluation",
    f"""
    WITH {OFFERING_SQL}
    SELECT event_id, "dictadoSKey", {KEY_SQL.format("ts")} AS "tiempoSKey", CAST(CAST(value AS DECIMAL(5, 2)) AS DOUBLE) AS "notaDictado"
    FROM events JOIN offerings ON "idDictado" = user_id * 2
    """,
)
def fact_evaluation(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        (F.col("user_id") * 2).alias("idDictado"),
        fn.date_key(F.to_date("ts")).alias("tiempoSKey"),
        F.col("value").cast("decimal(5,2)").cast("double").alias("notaDictado"),
    )
    resolved = facts.resolve_keys(rows, [facts.KeyLookup("idDictado", _offering_map(t), "idDictado", "dictadoSKey")])
    return facts.with_all_keys(resolved, ["dictadoSKey", "tiempoSKey"]).select(
        "event_id", "dictadoSKey", "tiempoSKey", "notaDictado"
    )


ORDER_CUT = dt.date(1998, 7, 1)
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def _orders(t: Tables) -> DataFrame:
    return t.orders.select(*ORDER_COLUMNS).withColumn("o_orderdate", F.to_date("o_orderdate"))


def _stored(t: Tables) -> DataFrame:
    """Orders up to the cut, and the finished ones after it."""
    return _orders(t).where((F.col("o_orderdate") < F.lit(ORDER_CUT)) | (F.col("o_orderstatus") == "F"))


def _incoming(t: Tables) -> DataFrame:
    """Orders from a year before the cut on, restated with new values."""
    recent = _orders(t).where(F.col("o_orderdate") >= F.lit(ORDER_CUT.replace(year=ORDER_CUT.year - 1)))
    return recent.withColumns(
        {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") * 2, "o_custkey": F.col("o_custkey") + 7}
    )


MERGE_SQL = """
    o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders),
    stored AS (SELECT * FROM o WHERE o_orderdate < DATE '1998-07-01' OR o_orderstatus = 'F'),
    incoming AS (SELECT o_orderkey, o_custkey + 7 AS o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice,
                        o_orderdate FROM o WHERE o_orderdate >= DATE '1997-07-01')
"""


@query(
    "insert_ignore",
    f"""
    WITH {MERGE_SQL} SELECT * FROM stored
    UNION ALL SELECT * FROM incoming WHERE o_orderkey NOT IN (SELECT o_orderkey FROM stored)
    """,
)
def insert_ignore(t: Tables) -> DataFrame:
    return merge.insert_ignore(_stored(t), _incoming(t), ["o_orderkey"])


@query(
    "insert_ignore_first_in_batch",
    """
    WITH stored AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < DATE '1997-01-01')
    SELECT DISTINCT l_orderkey, l_linenumber, CAST(NULL AS BIGINT) AS l_partkey, 'old' AS kind FROM stored
    UNION ALL
    SELECT * FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, 'new' AS kind FROM lineitem
      WHERE l_shipdate >= DATE '1997-01-01' AND (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM stored)
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) = 1)
    """,
)
def insert_ignore_first_in_batch(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    cut = F.lit("1997-01-01").cast("timestamp")
    stored = line.where(F.col("l_shipdate") < cut).select("l_orderkey", "l_linenumber").distinct().withColumn("kind", F.lit("old"))
    incoming = line.where(F.col("l_shipdate") >= cut).withColumn("kind", F.lit("new"))
    merged = merge.insert_ignore(
        stored, incoming, ["l_orderkey", "l_linenumber"], order_by=["l_partkey", "l_suppkey", "l_shipdate"]
    )
    return merged.select("l_orderkey", "l_linenumber", "l_partkey", "kind")


@query("append_without_key", f"WITH {MERGE_SQL} SELECT * FROM stored UNION ALL SELECT * FROM incoming")
def append_without_key(t: Tables) -> DataFrame:
    return merge.insert_ignore(_stored(t), _incoming(t), [])


@query(
    "upsert_partial",
    f"""
    WITH {MERGE_SQL}
    SELECT o_orderkey, CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_custkey ELSE i.o_custkey END AS o_custkey,
           CASE WHEN i.o_orderkey IS NOT NULL THEN i.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus,
           CASE WHEN i.o_orderkey IS NOT NULL THEN i.o_totalprice ELSE s.o_totalprice END AS o_totalprice,
           coalesce(s.o_orderdate, i.o_orderdate) AS o_orderdate
    FROM stored s FULL OUTER JOIN incoming i USING (o_orderkey)
    """,
)
def upsert_partial(t: Tables) -> DataFrame:
    return merge.upsert(_stored(t), _incoming(t), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(
    "upsert_counts",
    f"""
    WITH {MERGE_SQL}
    SELECT count(*) FILTER (o_orderkey NOT IN (SELECT o_orderkey FROM stored)) AS inserted,
           count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM stored)) AS updated
    FROM incoming
    """,
)
def upsert_counts(t: Tables) -> DataFrame:
    return merge.upsert_counts(_stored(t), _incoming(t), ["o_orderkey"])


CUSTOMER_POLICY = scd.ScdPolicy("idalumno", "alumnoSKey", type2=("programa", "segmento"), type1=("saldo",))


def _customer_dimension(t: Tables) -> DataFrame:
    rows = t.customer.select(
        (F.col("c_custkey") + 1).alias("alumnoSKey"),
        F.col("c_custkey").alias("idalumno"),
        F.col("c_name").alias("nombre"),
        F.col("c_nationkey").alias("programa"),
        F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("segmento"),
        F.col("c_acctbal").alias("saldo"),
    )
    return dimensions.versioned(rows, dt.date(2024, 1, 1))


def _customer_delta(t: Tables) -> DataFrame:
    """All customers again, some changed, with suppliers as newcomers."""
    nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
    known = t.customer.select(
        F.col("c_custkey").alias("idalumno"),
        F.upper("c_name").alias("nombre"),
        F.when(balance < 0, nation + 1).otherwise(nation).alias("programa"),
        F.when(nation != 5, F.col("c_mktsegment")).alias("segmento"),
        F.when(F.col("c_mktsegment") == "BUILDING", balance + 1).otherwise(balance).alias("saldo"),
    )
    new = t.supplier.select(
        (F.col("s_suppkey") + 10_000_000_000).alias("idalumno"),
        F.col("s_name").alias("nombre"),
        F.col("s_nationkey").alias("programa"),
        F.lit("NEW").alias("segmento"),
        F.col("s_acctbal").alias("saldo"),
    )
    return dimensions.versioned(known.unionByName(new), AS_OF)


SCD_SQL = """
    dim AS (SELECT c_custkey + 1 AS "alumnoSKey", c_custkey AS idalumno, c_name AS nombre, c_nationkey AS programa,
              CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS segmento, c_acctbal AS saldo,
              DATE '2024-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, TRUE AS es_actual FROM customer),
    delta AS (
      SELECT c_custkey AS idalumno, upper(c_name) AS nombre,
             CASE WHEN c_acctbal < 0 THEN c_nationkey + 1 ELSE c_nationkey END AS programa,
             CASE WHEN c_nationkey <> 5 THEN c_mktsegment END AS segmento,
             CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS saldo FROM customer
      UNION ALL SELECT s_suppkey + 10000000000, s_name, s_nationkey, 'NEW', s_acctbal FROM supplier),
    classified AS (
      SELECT d.*, c."alumnoSKey" AS old_sk, CASE WHEN c.idalumno IS NULL THEN 'insert'
               WHEN c.programa IS DISTINCT FROM d.programa OR c.segmento IS DISTINCT FROM d.segmento THEN 'new_version'
               WHEN c.saldo IS DISTINCT FROM d.saldo THEN 'update' ELSE 'same' END AS action
      FROM delta d LEFT JOIN dim c ON c.idalumno = d.idalumno)
"""


@query(
    "scd_apply",
    f"""
    WITH {SCD_SQL}
    SELECT m."alumnoSKey", m.idalumno, m.nombre, m.programa, m.segmento,
           CASE WHEN action = 'update' THEN c.saldo ELSE m.saldo END AS saldo, m.valid_from,
           CASE WHEN action = 'new_version' THEN DATE '2025-01-01' END AS valid_to, action IS DISTINCT FROM 'new_version' AS es_actual
    FROM dim m LEFT JOIN classified c ON c.old_sk = m."alumnoSKey"
    UNION ALL
    SELECT (SELECT max("alumnoSKey") FROM dim) + row_number() OVER (ORDER BY idalumno), idalumno, nombre, programa, segmento,
           saldo, DATE '2025-01-01', NULL, TRUE
    FROM classified WHERE action IN ('insert', 'new_version')
    """,
)
def scd_apply(t: Tables) -> DataFrame:
    return scd.apply_scd(_customer_dimension(t), _customer_delta(t), CUSTOMER_POLICY, AS_OF)


@query(
    "scd_counters",
    f"""
    WITH {SCD_SQL}
    SELECT count(*) FILTER (action IN ('insert', 'new_version')) AS insertados,
           count(*) FILTER (action = 'new_version') AS actualizados_scd2,
           count(*) FILTER (action = 'update') AS actualizados_scd1, count(*) FILTER (action = 'same') AS sin_cambios
    FROM classified
    """,
)
def scd_counters(t: Tables) -> DataFrame:
    return scd.scd_counts(scd.classify(_customer_dimension(t), _customer_delta(t), CUSTOMER_POLICY))


@query(
    "scd_actions",
    f'WITH {SCD_SQL} SELECT idalumno, old_sk, action FROM classified',
)
def scd_actions(t: Tables) -> DataFrame:
    rows = scd.classify(_customer_dimension(t), _customer_delta(t), CUSTOMER_POLICY)
    return rows.select("idalumno", F.col("_old_alumnoSKey").alias("old_sk"), F.col("_action").alias("action"))


@query(
    "value_changes",
    """
    SELECT p_partkey, p_size % 5 IN (1, 2) AS size_changed, p_size % 7 = 3 AS brand_changed,
           NOT (p_size % 5 NOT IN (1, 2) AND p_size % 7 <> 3) AS changed
    FROM part
    """,
)
def value_changes(t: Tables) -> DataFrame:
    size = F.col("p_size")
    fifth = F.pmod(size, F.lit(5))
    old = F.when(fifth == 1, F.lit(None)).when(fifth == 2, size + 1).otherwise(size)
    pairs = t.part.select(
        "p_partkey",
        F.when(fifth != 3, old).alias("_old_size"),
        F.when(fifth != 3, F.concat(size.cast("string"), F.lit(".0"))).alias("size"),
        F.col("p_brand").alias("_old_brand"),
        F.when(F.pmod(size, F.lit(7)) == 3, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("brand"),
    )
    return pairs.select(
        "p_partkey",
        fn.columns_changed(["size"], "_old_").alias("size_changed"),
        fn.columns_changed(["brand"], "_old_").alias("brand_changed"),
        fn.columns_changed(["size", "brand"], "_old_").alias("changed"),
    )


@query(
    "watermark_delta",
    "SELECT event_id, user_id, event_type, value FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'",
)
def watermark_delta(t: Tables) -> DataFrame:
    return watermark.rows_after(t.events, dt.datetime(2024, 1, 20, 12), "ts").select("event_id", "user_id", "event_type", "value")


@query(
    "bootstrap_latest_rows",
    "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 1000",
)
def bootstrap_latest_rows(t: Tables) -> DataFrame:
    return watermark.latest_rows(t.events, 1000, order_by="event_id").select("event_id", "user_id", "event_type", "value")


def _runs(t: Tables) -> DataFrame:
    """An audit log: every event is a run, ended by a click or a purchase."""
    ended = F.col("event_type").isin("click", "purchase")
    start = F.col("ts").cast("timestamp")
    opening = t.events.select(
        F.col("event_id").alias("id"),
        start.alias("inicio"),
        F.lit(None).cast("timestamp").alias("fin"),
        F.lit(None).cast("timestamp").alias("nueva_extraccion"),
        F.lit(watermark.RUNNING).alias("estado"),
    )
    state = F.when(F.col("event_type") == "click", F.lit(watermark.OK)).otherwise(F.lit(watermark.ERROR))
    closing = t.events.where(ended).select(
        F.col("event_id"), start, start + F.expr("INTERVAL 5 SECONDS"), start, state
    )
    return opening.union(closing)


@query(
    "audit_run_states",
    """
    SELECT event_id AS id, event_type IN ('click', 'purchase') AS ended,
           CASE event_type WHEN 'click' THEN 'OK' WHEN 'purchase' THEN 'ERROR' ELSE 'RUNNING' END AS estado
    FROM events
    """,
)
def audit_run_states(t: Tables) -> DataFrame:
    return watermark.run_states(_runs(t)).select("id", F.col("fin").isNotNull().alias("ended"), "estado")


@query(
    "latest_ok_watermark",
    "SELECT strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS nueva_extraccion FROM events WHERE event_type = 'click'",
)
def latest_ok_watermark(t: Tables) -> DataFrame:
    latest = watermark.latest_watermark(watermark.run_states(_runs(t)))
    return latest.select(F.date_format("nueva_extraccion", "yyyy-MM-dd HH:mm:ss").alias("nueva_extraccion"))
