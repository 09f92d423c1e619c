"""Session set-up shared by the pipelines, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. forceOptimizeSkewedJoin lets adaptive
# execution split a hot join partition even where that costs one more shuffle. The
# JVM never compiles a method of more than 8000 bytes, so stages whose generated
# method is larger run their operators' own, smaller ones.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# How files that the library writes for itself are compressed, to write and read fewer bytes.
COMPRESSION = "zstd"

# Rows of such files take some 20 times as much in memory (4 to 70 times as measured: ids in order, repeated words
# and nulls take next to nothing). Spark broadcasts a side of a join by the size of its files, and the driver builds
# its hash table: files below the limit of 10 MB held 1.6 million rows, a table of 235 MB. With the factor only
# files that are small as rows are broadcast at once; adaptive execution decides about others by their real size.
STORE_SETTINGS = {"spark.sql.sources.fileCompressionFactor": "20"}


def configure(spark: SparkSession, **more: str) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in {**RUNTIME_SETTINGS, **more}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "starloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local run may make its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="starloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


_scratch_folder: ContextVar[str | None] = ContextVar("scratch_folder", default=None)


# Folders of this process outside of any ``scratch`` block, by application.
_left: dict[str, list[str]] = {}


def new_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    inside = _scratch_folder.get()
    folder = f"{inside or spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    if not inside:
        _left.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_materialized(spark: SparkSession) -> int:
    """Delete what was materialized outside of ``scratch`` blocks; how many folders there were.

    Queries and operators that return frames leave the files these read. Call this when all
    frames of the session have been read or stored: they cannot be read afterwards.
    """
    folders = _left.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        _delete(spark, folder)
    return len(folders)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete everything that is materialized inside the block when it ends."""
    folder = new_folder(spark)
    token = _scratch_folder.set(folder)
    try:
        yield
    finally:
        _scratch_folder.reset(token)
        _delete(spark, folder)


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back.

    Cuts the lineage where a result feeds several later steps. A lost executor
    does not lose it, values that depend on row positions are fixed, and Spark
    knows the real size of what it reads when it picks a join.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path, compression=COMPRESSION)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """A small report as a frame that no longer depends on any file."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def side_by_side(steps: Sequence[Callable[[], object]], at_once: int = 8) -> list:
    """Run independent Spark actions from several threads; results in order.

    Small jobs then fill the cluster together instead of waiting for each other.
    """
    with ThreadPoolExecutor(at_once) as pool:
        return [task.result() for task in [pool.submit(copy_context().run, step) for step in steps]]
