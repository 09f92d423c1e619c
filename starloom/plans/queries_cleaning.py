"""Queries that exercise the column cleaners on whole tables.

The tables are clean, so each query first writes its values down in the messy
styles of an operational extract, and then reads them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom import functions as fn
from starloom.functions import documented
from starloom.operators import quality
from starloom.operators.dedupe import keep_one
from starloom.operators.joins import skew_safe_join
from starloom.plans.registry import REGISTRY, Tables
from starloom.plans.university import with_passed
from starloom.sources.staging import blank_null_tokens, stage

query = REGISTRY.query


def _pick(selector: Column, *choices: Column) -> Column:
    """The choice numbered by ``selector`` modulo the number of choices."""
    out = choices[-1]
    for i, choice in reversed(list(enumerate(choices[:-1]))):
        out = F.when(F.pmod(selector, F.lit(len(choices))) == i, choice).otherwise(out)
    return out


# A leading sharp s is title-cased to two letters.
TITLE_SQL = (
    "replace(array_to_string(list_transform(regexp_extract_all(lower(trim({0}, e' \\t\\n')), "
    "'[\\p{{L}}]+|[^\\p{{L}}]+'), lambda t: upper(t[1]) || t[2:]), ''), 'ẞ', 'Ss')"
)


@query(
    "clean_string_title",
    f"""
    WITH raw AS (
      SELECT 'part' AS kind, p_partkey AS id,
             e' \\t' || upper(p_name) || '-' || p_type || ' 2nd' || p_brand || ' ' AS raw FROM part
      UNION ALL
      SELECT 'supplier', s_suppkey, lower(s_name) || '''s o''NEIL' FROM supplier
      UNION ALL
      SELECT 'customer', c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 500 THEN '  '
             ELSE '  ' || upper(c_name) || '_' || lower(c_mktsegment) || e'\\n' END FROM customer
    )
    SELECT kind, id, {TITLE_SQL.format("raw")} AS cleaned FROM raw
    """,
)
def clean_string_title(t: Tables) -> DataFrame:
    part = t.part.select(
        F.lit("part").alias("kind"),
        F.col("p_partkey").alias("id"),
        F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("-"), "p_type", F.lit(" 2nd"), "p_brand", F.lit(" ")).alias("raw"),
    )
    supplier = t.supplier.select(
        F.lit("supplier"), "s_suppkey", F.concat(F.lower("s_name"), F.lit("'s o'NEIL"))
    )
    messy = F.concat(F.lit("  "), F.upper("c_name"), F.lit("_"), F.lower("c_mktsegment"), F.lit("\n"))
    customer = t.customer.select(
        F.lit("customer"),
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.lit(None)).when(F.col("c_acctbal") < 500, F.lit("  ")).otherwise(messy),
    )
    raw = part.union(supplier).union(customer)
    return raw.select("kind", "id", fn.clean_title(F.col("raw")).alias("cleaned"))


@query(
    "clean_title_documents",
    f"""
    SELECT doc_id, lang, md5({TITLE_SQL.format("text")}) AS title_md5 FROM documents
    """,
)
def clean_title_documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", F.md5(fn.clean_title(F.col("text"))).alias("title_md5"))


@query(
    "clean_int",
    """
    WITH n AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 10
             WHEN 5 THEN cents * 10 WHEN 6 THEN -cents WHEN 7 THEN NULL WHEN 9 THEN 9007199254740993 + o_orderkey
             ELSE cents END AS cleaned
    FROM n
    """,
)
def clean_int(t: Tables) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    text, grouped = cents.cast("string"), F.format_number(cents, 0)
    raw = _pick(
        F.col("o_orderkey"),
        text,
        grouped,
        F.translate(grouped, ",", "."),
        F.translate(grouped, ",", " "),
        F.concat(F.lit("\t+"), text, F.lit(" ")),
        F.concat(text, F.lit(".0")),
        F.concat(F.lit("-"), text),
        _pick(F.length(text), F.lit("n/a"), F.lit(""), F.concat(text, F.lit("d")), F.lit("inf"), F.lit(None)),
        F.concat(text, F.lit("e0")),
        (F.col("o_orderkey") + F.lit(9007199254740993)).cast("string"),
    )
    return t.orders.select("o_orderkey", fn.clean_integer(raw).alias("cleaned"))


@query(
    "clean_float",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate,
           CASE WHEN l_linenumber % 7 = 6 THEN NULL ELSE l_extendedprice END AS cleaned
    FROM lineitem
    """,
)
def clean_float(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    text, grouped = price.cast("decimal(18,2)").cast("string"), F.format_number(price, 2)
    raw = _pick(
        F.col("l_linenumber"),
        text,
        F.translate(text, ".", ","),
        grouped,
        F.translate(grouped, ",.", ".,"),
        F.concat(F.lit(" "), F.translate(grouped, ",", " "), F.lit(" ")),
        F.concat(F.lit("+"), text),
        _pick(F.col("l_partkey"), F.lit("None"), F.concat(text, F.lit("f")), F.lit("1.2.3"), F.lit("9" * 400), F.lit(None)),
    )
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").alias("l_shipdate"),
        fn.clean_decimal(raw).alias("cleaned"),
    )


@query(
    "clean_date_multi",
    """
    WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 14
             WHEN 5 THEN make_date(year(d), 1, 1)
             WHEN 9 THEN CASE day(d) % 7 WHEN 4 THEN DATE '2400-01-01' WHEN 6 THEN DATE '1500-03-02' END
             ELSE d END AS cleaned
    FROM d
    """,
)
def clean_date_multi(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    year, month, dom = F.year(day), F.month(day), F.dayofmonth(day)
    day_first = F.date_format(day, "dd-MM-yyyy")
    raw = _pick(
        F.col("o_orderkey"),
        F.date_format(day, "yyyy-MM-dd"),
        F.date_format(day, "dd/MM/yyyy"),
        F.date_format(day, "yyyyMMdd"),
        day_first,
        # A month-first text is only told apart from a day-first one past day 12.
        F.when(dom > 12, F.date_format(day, "MM-dd-yyyy")).otherwise(day_first),
        F.date_format(day, "yyyy"),
        F.date_format(day, "dd/MM/yy"),
        F.date_format(day, "yyyy/MM/dd"),
        F.concat_ws("-", year, month, dom),
        _pick(dom, F.lit("s/d"), F.lit("31/02/2020"), F.lit("Sin dato"), F.lit(None), F.lit("2400-01-01"), F.lit("00/05/2020"), F.lit("02/03/1500")),
        F.concat(F.lit("\t"), F.concat_ws("/", dom, month, year), F.lit(" ")),
        F.date_format(day, "yyyy-MM-dd 10:30:00"),
        F.date_format(day, "yyyy-MM-dd'T'00:00:00.000'Z'"),
        F.date_format(day, "dd/MM/yyyy 8:05"),
    )
    return t.orders.select("o_orderkey", fn.clean_date(raw).alias("cleaned"))


@query(
    "clean_gender_code",
    """
    SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'M' WHEN 'BUILDING' THEN 'M'
             WHEN 'FURNITURE' THEN 'F' WHEN 'HOUSEHOLD' THEN 'F' END AS gender
    FROM customer
    """,
)
def clean_gender_code(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    word = _pick(F.col("c_custkey"), F.lit("x"), F.lit(""), F.lit(None), F.lit("otro"))
    for name, words in {
        "AUTOMOBILE": ("m", " Masculino", "MALE\t"),
        "BUILDING": ("hombre", "1", "Hombre "),
        "FURNITURE": ("f", "femenino ", "Female"),
        "HOUSEHOLD": ("MUJER", "2", "F"),
    }.items():
        word = F.when(segment == name, _pick(F.col("c_custkey"), *[F.lit(w) for w in words])).otherwise(word)
    return t.customer.select("c_custkey", fn.clean_gender(word).alias("gender"))


@query(
    "clean_nationality_default",
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'No especificado' ELSE ' ' || n_name END AS nationality
    FROM customer JOIN nation ON n_nationkey = c_nationkey
    """,
)
def clean_nationality_default(t: Tables) -> DataFrame:
    named = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    raw = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit(" "), "n_name"))
    return named.select("c_custkey", fn.clean_nationality(raw).alias("nationality"))


@query(
    "state_flags",
    """
    WITH s AS (
      SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Abandonada' WHEN 'P' THEN
               CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'BAJA' END ELSE 'Activa' END AS estado
      FROM orders)
    SELECT o_orderkey, estado, coalesce(lower(estado) IN ('abandonada', 'abandonado', 'abandono', 'baja'), FALSE) AS abandono
    FROM s
    """,
)
def state_flags(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    state = (
        F.when(status == "F", F.lit("Abandonada"))
        .when(status == "P", F.when(F.col("o_orderpriority") != "1-URGENT", F.lit("BAJA")))
        .otherwise(F.lit("Activa"))
    )
    return t.orders.select("o_orderkey", state.alias("estado")).withColumn(
        "abandono", fn.matches_any(F.col("estado"), "abandonada", "abandonado", "abandono", "baja")
    )


@query(
    "passed_flag",
    """
    WITH r AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'APROBADO' WHEN 'R' THEN 'Desaprobado' END AS resultado
               FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate,
           coalesce(lower(resultado) = 'aprobado', FALSE) AS aprobado
    FROM r
    """,
)
def passed_flag(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    result = F.when(flag == "A", F.lit("APROBADO")).when(flag == "R", F.lit("Desaprobado"))
    marked = with_passed(t.lineitem.withColumn("resultado", result))
    return marked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("l_shipdate"), "aprobado")


@query(
    "range_null_reject",
    """
    WITH r AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate,
             CASE WHEN l_quantity - 10 >= 0 THEN l_quantity - 10 END AS hours,
             CASE WHEN l_discount * 200 BETWEEN 0 AND 10 THEN l_discount * 200 END AS grade,
             l_linenumber - 2 AS attempt
      FROM lineitem)
    SELECT * FROM r WHERE grade IS NOT NULL AND attempt > 0
    """,
)
def range_null_reject(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").alias("l_shipdate"),
        fn.non_negative(F.col("l_quantity") - 10).alias("hours"),
        fn.between_or_null(F.col("l_discount") * 200, 0, 10).alias("grade"),
        (F.col("l_linenumber") - 2).alias("attempt"),
    )
    valid, _ = quality.split_valid(rows, quality.all_present(["grade"]) & (F.col("attempt") > 0))
    return valid


@query(
    "invalid_row_split",
    """
    SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE NOT (c_acctbal >= 0 AND c_custkey * 90000 BETWEEN 1000000 AND 99999999)
    """,
)
def invalid_row_split(t: Tables) -> DataFrame:
    valid = fn.is_national_id(F.col("c_custkey") * 90000) & fn.non_negative(F.col("c_acctbal")).isNotNull()
    _, rejected = quality.split_valid(t.customer.select("c_custkey", "c_name", "c_acctbal"), valid)
    return rejected


@query(
    "digit_only_identifiers",
    """
    SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_partkey END AS id,
           p_size >= 10 AND p_partkey * 7000 BETWEEN 1000000 AND 99999999 AS usable
    FROM part
    """,
)
def digit_only_identifiers(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") >= 10, F.col("p_partkey").cast("string")).otherwise(
        F.concat(F.col("p_partkey").cast("string"), F.lit("."))
    )
    return t.part.select("p_partkey", fn.identifier(text).alias("id")).withColumn(
        "usable", fn.is_national_id(F.col("id") * 7000)
    )


@query(
    "age_at_entry",
    """
    WITH a AS (SELECT o_orderkey, o_orderpriority, CAST(left(o_orderpriority, 1) AS INTEGER) * 45 - 60 AS years FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderpriority <> '2-HIGH' AND years BETWEEN 0 AND 120 THEN years END AS age FROM a
    """,
)
def age_at_entry(t: Tables) -> DataFrame:
    years = F.substring("o_orderpriority", 1, 1).cast("int") * 45 - 60
    birth = F.when(F.col("o_orderpriority") != "2-HIGH", F.to_date("o_orderdate"))
    entry = F.year("o_orderdate") + years
    return t.orders.select("o_orderkey", fn.age_at(birth, entry).alias("age"))


@query(
    "year_to_date",
    """
    WITH y AS (SELECT o_orderkey, 1880 + CAST(o_orderkey % 200 AS INTEGER) AS y FROM orders)
    SELECT o_orderkey, CASE WHEN y BETWEEN 1900 AND 2035 THEN make_date(y, 1, 1) END AS day FROM y
    """,
)
def year_to_date(t: Tables) -> DataFrame:
    text = F.concat(F.lit(" "), (F.pmod("o_orderkey", F.lit(200)) + 1880).cast("string"))
    return t.orders.select("o_orderkey", fn.year_start(fn.clean_integer(text), 2025).alias("day"))


MONTHS_SQL = (
    "list_extract(['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto',"
    "'Septiembre','Octubre','Noviembre','Diciembre'], CAST(month({0}) AS INTEGER))"
)
KEY_SQL = "CAST(year({0}) * 10000 + month({0}) * 100 + day({0}) AS INTEGER)"
PERIOD_SQL = "CASE WHEN month({0}) <= 7 THEN 'C1-' ELSE 'C2-' END || CAST(year({0}) AS VARCHAR)"


@query(
    "calendar_attributes",
    f"""
    SELECT event_id, {KEY_SQL.format("ts")} AS date_key, {PERIOD_SQL.format("ts")} AS period,
           {MONTHS_SQL.format("ts")} AS month_name
    FROM events
    """,
)
def calendar_attributes(t: Tables) -> DataFrame:
    day = F.to_date("ts")
    return t.events.select(
        "event_id",
        fn.date_key(day).alias("date_key"),
        fn.academic_period(day).alias("period"),
        fn.month_name_es(day).alias("month_name"),
    )


@query(
    "evaluation_date_enrich",
    """
    WITH calendar AS (
      SELECT o_custkey, arg_max(CAST(year(o_orderdate) AS VARCHAR) ||
               CASE WHEN o_orderstatus = 'F' THEN '-07-15' ELSE '-12-15' END, o_orderkey) AS fecha
      FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' GROUP BY o_custkey)
    SELECT event_id, coalesce(fecha, '2025-06-30') AS fecha_evaluacion
    FROM events LEFT JOIN calendar ON o_custkey = user_id * 9
    """,
)
def evaluation_date_enrich(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    period = F.when(status == "F", F.lit(" c1")).when(status == "O", F.lit("Segundo")).otherwise(F.lit("verano"))
    year = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("s/d")).otherwise(F.year("o_orderdate").cast("string"))
    terms = t.orders.select("o_custkey", "o_orderkey", fn.evaluation_date(period, year).alias("fecha"))
    calendar = keep_one(terms.where(F.col("fecha").isNotNull()), ["o_custkey"], ["o_orderkey"], keep="last")
    evaluations = t.events.select("event_id", (F.col("user_id") * 9).alias("o_custkey"))
    return skew_safe_join(evaluations, calendar, ["o_custkey"]).select(
        "event_id", F.coalesce("fecha", F.lit("2025-06-30")).alias("fecha_evaluacion")
    )


@query(
    "null_tokens_on_read",
    """
    SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1) THEN NULL WHEN p_size % 5 = 2 THEN 'none'
             WHEN p_size % 5 = 3 THEN ' NA ' ELSE p_brand END AS brand, p_type AS kind
    FROM part
    """,
)
def null_tokens_on_read(t: Tables) -> DataFrame:
    brand = _pick(F.col("p_size"), F.lit("N/A"), F.lit(""), F.lit("none"), F.lit(" NA "), F.col("p_brand"))
    return blank_null_tokens(t.part.select("p_partkey", brand.alias("brand"), F.col("p_type").alias("kind")))


@query(
    "stage_rows",
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey_raw, s_name AS s_name_raw,
           CAST(s_nationkey AS VARCHAR) AS s_nationkey_raw, 'supplier.csv' AS archivo_origen,
           TIMESTAMP '2025-01-01 00:00:00' AS fecha_carga
    FROM supplier
    """,
)
def stage_rows(t: Tables) -> DataFrame:
    text = t.supplier.select(*[F.col(c).cast("string").alias(c) for c in ("s_suppkey", "s_name", "s_nationkey")])
    return stage(text, "supplier.csv", F.lit("2025-01-01 00:00:00").cast("timestamp"))


@query(
    "documented_text",
    """
    SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) THEN NULL ELSE p_name || ' ñandú ' || p_type END AS cleaned
    FROM part
    """,
)
def documented_text(t: Tables) -> DataFrame:
    whole = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  \t")), F.lit("   ñandú "), "p_type", F.lit("\n"))
    misread = F.decode(F.encode(whole, "UTF-8"), "ISO-8859-1")
    raw = _pick(F.col("p_size"), F.lit("S/D "), F.lit(" NA"), whole, misread)
    return t.part.select("p_partkey", documented.clean_text(raw).alias("cleaned"))


@query(
    "documented_codes",
    """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'M' WHEN '2-HIGH' THEN 'F' WHEN '3-MEDIUM' THEN 'X' END AS gender,
           CASE o_orderstatus WHEN 'F' THEN 'Activa' WHEN 'O' THEN 'Abandonada' ELSE 'otro' END AS state,
           CASE WHEN o_orderstatus = 'F' THEN TRUE WHEN o_orderstatus = 'O' THEN FALSE
                ELSE o_totalprice / 50000 >= 4 END AS passed,
           CAST(trunc(o_totalprice) AS BIGINT) AS whole
    FROM orders
    """,
)
def documented_codes(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    gender = (
        F.when(priority == "1-URGENT", F.lit("hombre")).when(priority == "2-HIGH", F.lit("2"))
        .when(priority == "3-MEDIUM", F.lit(" no binario")).otherwise(F.lit("?"))
    )
    state = F.when(status == "F", F.lit("Cursando ")).when(status == "O", F.lit("BAJA")).otherwise(F.lit("otro"))
    result = F.when(status == "F", F.lit("Sí")).when(status == "O", F.lit("ausente")).otherwise(F.lit(" "))
    price = F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ",")
    return t.orders.select(
        "o_orderkey",
        documented.clean_gender_with_other(gender).alias("gender"),
        documented.canonical_state(state).alias("state"),
        documented.passed_or_inferred(result, F.col("o_totalprice") / 50000).alias("passed"),
        documented.truncated_integer(price).alias("whole"),
    )


@query(
    "documented_scores",
    """
    SELECT event_id, coalesce(CAST(value AS DECIMAL(12,2)) BETWEEN 0 AND 10, FALSE) AS valid_score FROM events
    """,
)
def documented_scores(t: Tables) -> DataFrame:
    return t.events.select("event_id", documented.valid_score(F.col("value").cast("decimal(12,2)")).alias("valid_score"))
