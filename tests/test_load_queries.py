"""Steps of the load behind the load_ queries, on small tables of their own."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starloom.operators.groups import repeated_in_groups
from starloom.operators.joins import keep_matching
from starloom.plans import queries_pipeline as qp
from starloom.plans import university as u
from starloom.plans.initial_load import open_staging, open_warehouse
from starloom.session import materialize
from starloom.sources.staging import number_in_file_order, read_csv
from starloom.sources.store import TableStore


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables whose rows lie in no order, in several files."""
    root = tmp_path_factory.mktemp("tables")
    number = (F.col("id") * 7919) % 1009
    day = F.date_add(F.lit(dt.date(1997, 1, 1)), ((F.col("id") * 31) % 365).cast("int"))
    tables = {
        "part": [number.alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("brand#1").alias("p_brand"), (1 + number % 50).cast("int").alias("p_size")],
        "customer": [number.alias("c_custkey"), F.lit("c#1").alias("c_name"), F.when(number % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment"), (number % 25).cast("int").alias("c_nationkey")],
        "orders": [number.alias("o_orderkey"), (number % 50).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), day.alias("o_orderdate")],
        "lineitem": [
            (number % 100).alias("l_orderkey"), (number % 7).alias("l_partkey"), (number % 5).alias("l_suppkey"), (1 + number % 7).cast("int").alias("l_linenumber"),
            F.lit(4.0).alias("l_quantity"), F.lit("A").alias("l_returnflag"), day.alias("l_shipdate"),
        ],
    }
    for name, columns in tables.items():
        spark.range(1, 1001, numPartitions=4).select(*columns).write.parquet(f"{root}/{name}.parquet")
    return str(root)


MADE = [(qp.RENDERED, s, late) for s in ("curso", "estudiante", "dictado", "inscripcion", "examen", "curso_programa") for late in (False, True)]
MADE += [(qp.LATER_RENDERED, s, True) for s in ("estudiante", "dictado")]


@pytest.mark.parametrize("rendered,source,late", MADE)
def test_extracts_are_ordered_before_they_are_rendered(spark, folder, rendered, source, late):
    """Columns of the tables move, not their text, and row numbers still never fall."""
    df = rendered[source](qp.Period(spark, folder, late))
    numbers = [r.row_id for r in df.select("row_id").collect()]
    assert len(numbers) > 100 and numbers == sorted(numbers)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "_raw" not in below.split("Relation")[0]


def test_extract_keeps_the_order(spark, folder, tmp_path):
    made = qp.RENDERED["inscripcion"](qp.Period(spark, folder))
    qp.write_extract(made, "inscripcion", f"{tmp_path}/inscripcion.csv")
    rows = spark.read.csv(f"{tmp_path}/inscripcion.csv", header=True).withColumn("at", F.monotonically_increasing_id())
    files = rows.select(F.col("_metadata.file_name").alias("file"), "at", F.col("id_inscripcion").cast("bigint").alias("id")).orderBy("file", "at").collect()
    assert [r.id for r in files] == sorted(r.id for r in files) and len(files) == made.count()


def test_row_numbers_are_counted_exactly(spark):
    numbers = [1, 2, 2, 3, None, 32768, 32769, 65536, 65537, 10**12, -1, -32768, -32769, 0, 10**12]
    staged = spark.createDataFrame([(n, "f.csv") for n in numbers], "row_id bigint, archivo_origen string").repartition(3)
    for rows in (staged, staged.limit(0), staged.where("row_id is null")):
        plain = rows.agg(F.countDistinct("row_id"), F.max("row_id"), F.min("row_id"), F.max("archivo_origen")).first()
        assert tuple(qp.numbered_rows(rows, "t").first()) == ("t", *plain)


def test_groups_of_several_ids_are_written_down(spark):
    """The pairs are then joined to what is known to be small."""
    pairs = spark.createDataFrame([(1, 5), (1, 3), (2, 9), (None, 1), (1, 5)], "g bigint, id bigint")
    repeated = repeated_in_groups(pairs, ["g"], "id")
    assert repeated.inputFiles() and {tuple(r) for r in repeated.collect()} == {(1, 5, 3)}


def test_extracts_and_stored_files_are_compressed(spark, folder, tmp_path):
    """Fewer bytes are written; the staged rows and their order stay."""
    made = qp.RENDERED["inscripcion"](qp.Period(spark, folder))
    qp.write_extract(made, "inscripcion", f"{tmp_path}/inscripcion.csv")
    assert all(p.name.endswith(".csv.gz") for p in (tmp_path / "inscripcion.csv").glob("part-*"))
    read = number_in_file_order(read_csv(spark, f"{tmp_path}/inscripcion.csv", u.SOURCE_COLUMNS["inscripcion"]))
    rows = read.orderBy("row_id").select("row_id", F.col("id_inscripcion").cast("bigint").alias("id")).collect()
    assert [r.row_id for r in rows] == list(range(1, made.count() + 1)) and [r.id for r in rows] == sorted(r.id for r in rows)
    store = TableStore(spark, f"{tmp_path}/store", {"t": "id bigint", "p": "id bigint"}, parts={"p": "id % 2"})
    for table in ("t", "p"):
        store.append(table, spark.range(4))
    for df in (store.read("t"), store.read("p"), materialize(spark.range(4))):
        assert all(f.endswith(".zstd.parquet") for f in df.inputFiles()) and sorted(r.id for r in df.collect()) == [0, 1, 2, 3]


def test_keys_are_checked_exactly(spark):
    """Bitmaps tell what a count of distinct keys tells, and no key moves by itself."""
    for keys in ([1, 2, 3], [1, 2, 2], [1, 3], [1, 2, 2, 4], [2, 3], [None, 1], [None], [], [0, 1], list(range(1, 70_001)), [-1, 1, 2]):
        rows = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(3)
        plain = rows.agg(F.min("k"), F.max("k") == F.count("k"), F.countDistinct("k") == F.count("*")).first()
        checked = qp.checked_keys(rows, "k", "t")
        assert tuple(checked.first()) == ("t", *plain), keys[:5]
    assert "distinct" not in checked._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("opened", [open_staging, open_warehouse])
def test_many_rows_in_small_files_are_not_broadcast(spark, tmp_path, opened):
    """The driver builds the hash table of a broadcast, so joins go by what rows take and not by their files."""
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    opened(spark, f"{tmp_path}/store")
    plans = {}
    for rows in (1_000, 2_000_000):
        keys = materialize(spark.range(rows))
        assert sum(Path(f.removeprefix("file:")).stat().st_size for f in keys.inputFiles()) < 10_000_000
        joined = keep_matching(spark.range(20_000_000), keys, ["id"])
        plans[rows] = joined._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plans[1_000]
    assert "SortMergeJoin" in plans[2_000_000] and "Broadcast" not in plans[2_000_000]
