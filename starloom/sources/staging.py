"""CSV extracts into string-typed staging rows with lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from starloom.functions import evaluation_date, strip
from starloom.operators.dedupe import keep_one
from starloom.operators.joins import skew_safe_join
from starloom.session import materialize

# Tokens read as null, compared with the exact unstripped text.
NULL_ON_READ = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Quotes inside quoted text are doubled, and header names must match the schema. A
# line with too few or too many fields is kept as text beside its columns.
BROKEN_LINE = "_broken_line"
LINE_END = "\ue000end of line"
_FORMAT = {"quote": '"', "escape": '"'}
CSV_OPTIONS = {**_FORMAT, "header": True, "enforceSchema": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN_LINE}

RAW_SUFFIX = "_raw"
ROW_ID, SOURCE_FILE, LOADED_AT = "row_id", "archivo_origen", "fecha_carga"


def blank_null_tokens(df: DataFrame) -> DataFrame:
    """Every null token of the text columns becomes null."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != BROKEN_LINE]
    return df.withColumns({c: F.when(~F.col(c).isin(*NULL_ON_READ), F.col(c)) for c in texts})


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def line_schema(columns: Sequence[str]) -> StructType:
    """The columns of an extract as they are read, with the text of lines that do not fit."""
    return text_schema([*columns, BROKEN_LINE])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = False) -> DataFrame:
    """A comma CSV with header, all columns as text, in header order given by ``columns``.

    ``multi_line`` allows line breaks inside quotes, at the price of unsplittable files.
    Lines with another number of fields are in ``BROKEN_LINE`` too; see ``line_report``.
    """
    raw = spark.read.csv(path, schema=line_schema(columns), multiLine=multi_line, **CSV_OPTIONS)
    return blank_null_tokens(raw)


class BrokenSource(RuntimeError):
    """Lines of an extract do not fit its columns, so reading on would lose values."""


@dataclass(frozen=True)
class LineReport:
    rows: int
    short: int


def line_report(df: DataFrame, source: str, columns: Sequence[str]) -> LineReport:
    """Count the written-down rows of ``read_csv`` and stop at lines that lost something.

    A line with too many fields, or with an odd number of quotes (a line break inside
    quotes, read without ``multi_line``), stops the load. Short lines are rows whose
    last columns are null; they are kept and counted.
    """
    line = F.col(BROKEN_LINE)
    names = [f"c{i}" for i in range(len(columns) + 1)]
    # Empty fields read as null, so one field more is added: it lies among the first only if no other is too many.
    fields = F.from_csv(F.concat(line, F.lit("," + LINE_END)), ", ".join(f"{c} string" for c in names), _FORMAT)
    long = line.isNotNull() & ~F.exists(F.array(*[fields[c] for c in names]), lambda f: f.eqNullSafe(F.lit(LINE_END)))
    open_quote = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(open_quote).alias("open"),
        F.count_if(~open_quote & long).alias("long"),
        F.count_if(line.isNotNull()).alias("broken"),
    ).first()
    if counts["open"]:
        raise BrokenSource(f"{source}: {counts['open']} lines break inside quotes; read it with multi_line")
    if counts["long"]:
        raise BrokenSource(f"{source}: {counts['long']} lines have more than {len(columns)} fields")
    return LineReport(counts["rows"], counts["broken"])


def stage(df: DataFrame, source: str, loaded_at: Column) -> DataFrame:
    """Mark the business columns as raw and add where and when they came from.

    The row number, if there already, keeps its name.
    """
    return df.toDF(*[c if c == ROW_ID else c + RAW_SUFFIX for c in df.columns]).withColumns(
        {SOURCE_FILE: F.lit(source), LOADED_AT: loaded_at}
    )


def with_file_position(df: DataFrame) -> DataFrame:
    """Add the file and split each row comes from. ``df`` is read straight from files."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def number_positions(df: DataFrame, start: int = 1) -> DataFrame:
    """Dense ``row_id`` in file order for rows that carry their file and split.

    The positions are written down first; then one offset per split is enough. The
    offsets are written down as well, so that Spark knows how few they are and
    broadcasts them: rows are neither shuffled nor sorted.
    """
    placed = materialize(df.withColumn("_position", F.monotonically_increasing_id()))
    splits = placed.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_position").alias("_first")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    offsets = materialize(offsets)
    row_id = F.lit(start) + F.col("_offset") + F.col("_position") - F.col("_first")
    columns = [c for c in df.columns if c not in {"_file", "_block"}]
    return placed.join(offsets, ["_file", "_block"]).select(row_id.cast("bigint").alias(ROW_ID), *columns)


def number_in_file_order(df: DataFrame, start: int = 1) -> DataFrame:
    return number_positions(with_file_position(df), start)


def academic_calendar(
    offerings: DataFrame, id_col: str, period: str, year: str, order_by: Sequence[str]
) -> DataFrame:
    """End date per offering id, the last usable row of an id winning."""
    dated = offerings.select(
        strip(F.col(id_col)).alias(id_col),
        *[c for c in order_by if c != id_col],
        evaluation_date(F.col(period), F.col(year)).alias("fecha_evaluacion"),
    ).where(F.col("fecha_evaluacion").isNotNull() & (F.col(id_col) != ""))
    return keep_one(dated, [id_col], order_by, keep="last").select(id_col, "fecha_evaluacion")


def add_evaluation_date(
    evaluations: DataFrame, calendar: DataFrame, id_col: str, as_of: str
) -> DataFrame:
    """Add ``fecha_evaluacion`` from the calendar, ``as_of`` for unknown offerings.

    Evaluations that carry the date already are left alone.
    """
    if "fecha_evaluacion" in evaluations.columns:
        return evaluations
    keyed = evaluations.withColumn("_offering", strip(F.col(id_col)))
    lookup = calendar.select(F.col(id_col).alias("_offering"), "fecha_evaluacion")
    return skew_safe_join(keyed, lookup, ["_offering"]).select(
        *evaluations.columns, F.coalesce("fecha_evaluacion", F.lit(as_of)).alias("fecha_evaluacion")
    )


def source_report(spark: SparkSession, folder: str, files: Mapping[str, str], known_tables: Sequence[str]) -> DataFrame:
    """One row per extract: whether it exists, its bytes, and whether its table is known."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for file, table in files.items():
        path = hadoop.Path(f"{folder}/{file}")
        system = path.getFileSystem(conf)
        exists = system.exists(path)
        size = system.getContentSummary(path).getLength() if exists else None
        rows.append((file, table, exists, size, table in known_tables))
    return spark.createDataFrame(
        rows, "archivo string, tabla string, existe boolean, bytes bigint, tabla_existe boolean"
    )
