"""New extract files in a landing folder, picked up by Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.plans import university as u
from starloom.plans.incremental import IncrementalReport, run_incremental
from starloom.session import scratch
from starloom.sources.audit import AuditLog
from starloom.sources.staging import (
    BROKEN_LINE,
    CSV_OPTIONS,
    ROW_ID,
    academic_calendar,
    add_evaluation_date,
    blank_null_tokens,
    line_report,
    line_schema,
    number_positions,
    stage,
    with_file_position,
)
from starloom.sources.store import TableStore


def _stage_batch(
    staging: TableStore, source: str, rows: DataFrame, label: str, now: Callable[[], dt.datetime]
) -> None:
    """Append one micro-batch to its staging table, once even if it is replayed."""
    if rows.isEmpty() or staging.was_published(label):
        return
    staging.discard()
    try:
        with scratch(staging.spark):
            _append_rows(staging, source, rows, now())
        staging.publish(label)
    except BaseException:
        staging.discard()
        raise


def _append_rows(staging: TableStore, source: str, rows: DataFrame, loaded_at: dt.datetime) -> None:
    table = u.staging_name(source)
    read = number_positions(blank_null_tokens(rows), staging.next_number(table))
    line_report(read, source, u.SOURCE_COLUMNS[source])
    numbered = read.drop(BROKEN_LINE)
    if source == "evaluacion_curso":
        calendar = academic_calendar(
            staging.read(u.staging_name("dictado")), "id_dictado_raw", "periodo_raw", "anio_academico_raw", [ROW_ID]
        ).withColumnRenamed("id_dictado_raw", "id_dictado")
        numbered = add_evaluation_date(numbered, calendar, "id_dictado", loaded_at.date().isoformat())
    staging.append(table, stage(numbered, f"{source}.csv", F.lit(loaded_at)))


def ingest(
    staging: TableStore,
    landing: str,
    checkpoints: str,
    source: str,
    now: Callable[[], dt.datetime] = dt.datetime.now,
    multi_line: bool = False,
) -> StreamingQuery:
    """Stage all files of ``landing/<source>/`` that no earlier run has seen.

    A file with lines that do not fit the columns stops the query, staging nothing
    of its batch; ``multi_line`` allows line breaks inside quotes.
    """
    files = staging.spark.readStream.schema(line_schema(u.SOURCE_COLUMNS[source])).options(**CSV_OPTIONS, multiLine=multi_line)
    rows = with_file_position(files.csv(f"{landing}/{source}"))
    return (
        rows.writeStream.foreachBatch(
            lambda batch, number: _stage_batch(staging, source, batch, f"{source}:{number}", now)
        )
        .option("checkpointLocation", f"{checkpoints}/{source}")
        .trigger(availableNow=True)
        .start()
    )


def run_cycle(
    staging: TableStore,
    warehouse: TableStore,
    audit: AuditLog,
    landing: str,
    checkpoints: str,
    sources: list[str] | None = None,
    now: Callable[[], dt.datetime] = dt.datetime.now,
    **options: object,
) -> IncrementalReport:
    """Stage what has landed, then load it; ``options`` are those of ``run_incremental``.

    Offerings are staged before evaluations, whose dates depend on them. Sources
    are staged one after another, since the store has one writer at a time.
    """
    for source in sources or list(u.SOURCE_COLUMNS):
        ingest(staging, landing, checkpoints, source, now).awaitTermination()
    return run_incremental(staging, warehouse, audit, **options)


def run_periodically(
    staging: TableStore,
    warehouse: TableStore,
    audit: AuditLog,
    landing: str,
    checkpoints: str,
    every: str = "30 seconds",
    sources: list[str] | None = None,
) -> StreamingQuery:
    """Repeat ``run_cycle``, with a processing-time trigger as the clock."""
    ticks = staging.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(
            lambda _, __: run_cycle(staging, warehouse, audit, landing, checkpoints, sources)
        )
        .option("checkpointLocation", f"{checkpoints}/ticks")
        .trigger(processingTime=every)
        .start()
    )
