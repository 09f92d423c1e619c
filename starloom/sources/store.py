"""Tables as published snapshots in a shared folder."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.session import COMPRESSION

PUBLISHED = "published"
_PUBLISHED_SCHEMA = "version bigint, tabla string, rutas array<string>, etiqueta string, mayor bigint"
_PART = "parte"
_ASIDE = "_publicando"
# The number of a part is its group times this, plus its bucket.
_GROUP = 10_000


class ConflictingWriter(RuntimeError):
    """Another writer has published a table since this one read the state."""


@dataclass
class TableStore:
    """A set of tables whose new states become visible together.

    A state is a list of folders per table. Writers put files into new folders
    only, so a path that is being read is never overwritten, and an append does
    not rewrite what is stored. Tables named in ``parts`` are split into one
    folder per value of an integer expression, so that an update rewrites the
    touched parts only; tables in ``buckets`` by the hash of a key besides, so that
    few keys are looked up in few folders. Of tables in ``numbered`` the largest
    value of a column is kept with the list of folders. ``publish`` adds the lists
    of all changed tables in one small file, which is the commit point: a run that
    fails before it leaves the old state in place.

    The expressions of a table must stay what they were when it was first written.
    """

    spark: SparkSession
    root: str
    schemas: Mapping[str, str]
    parts: Mapping[str, str] = field(default_factory=dict)
    buckets: Mapping[str, str] = field(default_factory=dict)
    numbered: Mapping[str, str] = field(default_factory=dict)
    _pending: dict[str, list[str]] = field(default_factory=dict)
    _tops: dict[str, int | None] = field(default_factory=dict)
    _state: tuple[int, dict[str, list[str]], dict[str, int | None]] | None = None
    _written: int = 0

    def _published(self) -> tuple[int, dict[str, list[str]], dict[str, int | None]]:
        """The last version, and the folders and the largest number of every table; read once per run."""
        if self._state is None:
            try:
                log = self.spark.read.schema(_PUBLISHED_SCHEMA).parquet(f"{self.root}/{PUBLISHED}")
                latest = log.groupBy("tabla").agg(
                    F.max("version").alias("version"), F.max_by(F.struct("rutas", "mayor"), "version").alias("last")
                )
                rows = latest.select("tabla", "version", "last.*").collect()
            except AnalysisException:
                rows = []
            folders = {row.tabla: list(row.rutas) for row in rows}
            self._state = max((row.version for row in rows), default=0), folders, {row.tabla: row.mayor for row in rows}
        return self._state

    def _part(self, table: str) -> str | None:
        """The expression of a row's part."""
        group, bucket = self.parts.get(table), self.buckets.get(table)
        return f"({group}) * {_GROUP} + ({bucket})" if group and bucket else group or bucket

    def _folders(self, table: str) -> list[str]:
        """The folders of the next state so far."""
        if table not in self.schemas:
            raise ValueError(f"unknown table {table!r}")
        return self._pending.get(table, self._published()[1].get(table, []))

    def _open(self, table: str, folders: Sequence[str]) -> DataFrame:
        schema = StructType.fromDDL(self.schemas[table])
        if not folders:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            return self.spark.range(0).select(*empty)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, table: str) -> DataFrame:
        """The table with this run's unpublished changes; empty before the first load."""
        return self._open(table, self._folders(table))

    def version(self) -> int:
        """The last published version."""
        return self._published()[0]

    def extends(self, table: str, version: int) -> bool:
        """Whether a table still holds every folder it had at a published version: it was only added to since."""
        return set(self._folders_at(table, version)) <= set(self._folders(table))

    def read_at(self, table: str, version: int) -> DataFrame:
        """The table as it was at a published version; folders of old versions are not deleted."""
        self._folders(table)
        return self._open(table, self._folders_at(table, version))

    def _folders_at(self, table: str, version: int) -> list[str]:
        try:
            log = self.spark.read.schema(_PUBLISHED_SCHEMA).parquet(f"{self.root}/{PUBLISHED}")
        except AnalysisException:
            return []
        old = log.where((F.col("tabla") == table) & (F.col("version") <= version)).agg(F.max_by("rutas", "version")).first()[0]
        return list(old or [])

    def read_since(self, table: str, version: int | None) -> DataFrame:
        """Rows published after a version (None: all); no older folder is read.

        A table that was replaced since then is new as a whole.
        """
        self._folders(table)
        published = self._published()[1].get(table, [])
        old = set() if version is None else set(self._folders_at(table, version))
        return self._open(table, [f for f in published if f not in old])

    def parts_of(self, table: str, df: DataFrame) -> list[int]:
        """The parts that rows of a frame belong to; it has to have the columns that decide it."""
        return sorted(row[0] for row in df.select(F.expr(self._part(table)).cast("int")).distinct().collect())

    def read_keys(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows that can have one of some keys: those in the buckets of the keys, whatever their group.

        A table without buckets is read as a whole.
        """
        if table not in self.buckets:
            return self.read(table)
        asked = {row[0] for row in keys.select(F.expr(self.buckets[table]).cast("int")).distinct().collect()}
        return self._open(table, [f for f in self._folders(table) if _part_of(f) % _GROUP in asked])

    def next_number(self, table: str) -> int:
        """One more than the largest value of the numbered column, without a look at stored rows."""
        top = self._tops.get(table, self._published()[2].get(table))
        if top is None and self._folders(table):  # written before the largest number was kept
            top = self.read(table).agg(F.max(self.numbered[table])).first()[0]
        return (top or 0) + 1

    def read_parts(self, table: str, values: Sequence[int]) -> DataFrame:
        """The rows of some parts; no other folder is read."""
        return self._open(table, [f for f in self._folders(table) if _in_parts(f, values)])

    def _write(self, table: str, df: DataFrame) -> list[str]:
        """Write rows in table order and type, missing columns as null."""
        version, self._written = self._published()[0] + 1, self._written + 1
        folder = f"{self.root}/{table}/v={version:06d}-{self._written:03d}"
        rows = df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in StructType.fromDDL(self.schemas[table]).fields
            ]
        )
        if not self._part(table):
            rows.write.mode("overwrite").parquet(folder, compression=COMPRESSION)
            self._note_top(table, folder)
            return [folder]
        placed = rows.withColumn(_PART, F.expr(self._part(table)).cast("int"))
        # Rebalancing brings the rows of a part together for few files, and splits a
        # part that is too big for one task.
        balanced = placed.hint("rebalance", F.col(_PART))
        balanced.write.mode("overwrite").partitionBy(_PART).parquet(folder, compression=COMPRESSION)
        written = self.spark.read.schema(f"{_PART} int").parquet(folder).distinct().collect()
        self._note_top(table, folder)
        return [f"{folder}/{_PART}={row[0]}" for row in written]

    def _note_top(self, table: str, folder: str) -> None:
        """Keep the largest number, from the new files alone. It never falls, so no number is given twice."""
        if table in self.numbered:
            column = self.numbered[table]
            top = self.spark.read.schema(f"{column} bigint").parquet(folder).agg(F.max(column)).first()[0]
            self._tops[table] = max(top or 0, self.next_number(table) - 1)

    def replace(self, table: str, df: DataFrame) -> None:
        """Make ``df`` the whole next state of a table."""
        self._folders(table)
        self._tops[table] = 0  # no stored row stays
        self._pending[table] = self._write(table, df)

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to the next state."""
        self._pending[table] = [*self._folders(table), *self._write(table, df)]

    def replace_parts(self, table: str, df: DataFrame, values: Sequence[int]) -> None:
        """Make ``df`` the whole content of some parts; other parts stay as they are."""
        kept = [f for f in self._folders(table) if not _in_parts(f, values)]
        self._pending[table] = [*kept, *self._write(table, df)]

    def pending_rows(self) -> dict[str, DataFrame]:
        """The rows of files written and not yet published, by table; rewritten rows are among them."""
        published = self._published()[1]
        new = {t: [f for f in folders if f not in set(published.get(t, []))] for t, folders in self._pending.items()}
        return {table: self._open(table, folders) for table, folders in new.items() if folders}

    def publish(self, label: str | None = None) -> int:
        """Make everything written so far visible; returns the version.

        Each version is one file that can be created once. If another writer has created it, this
        one goes on with the next version, unless both wrote to one table: then it is refused
        with ``ConflictingWriter``, and its changes are dropped.
        """
        try:
            return self._publish(label) if self._pending else self._published()[0]
        finally:
            self.discard()

    def _publish(self, label: str | None) -> int:
        base = self._published()
        tops = base[2] | self._tops
        version = base[0] + 1
        while True:
            rows = [(version, table, folders, label, tops.get(table)) for table, folders in self._pending.items()]
            if self._create_version(version, self.spark.createDataFrame(rows, _PUBLISHED_SCHEMA)):
                return version
            self._state = None
            latest = self._published()
            both = [table for table in self._pending if latest[1].get(table) != base[1].get(table)]
            if both:
                raise ConflictingWriter(f"{', '.join(both)} of {self.root} was published by another writer")
            version = latest[0] + 1

    def _create_version(self, version: int, log: DataFrame) -> bool:
        """Write the log of a version aside and give it its name; False if the name is taken."""
        context = self.spark.sparkContext
        hadoop, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
        aside = hadoop.Path(f"{self.root}/{_ASIDE}/{uuid.uuid4().hex}")
        log.coalesce(1).write.parquet(aside.toString())
        files = aside.getFileSystem(conf)
        target = files.makeQualified(hadoop.Path(f"{self.root}/{PUBLISHED}/version-{version:09d}.parquet"))
        files.mkdirs(target.getParent())
        written = next(s.getPath() for s in files.listStatus(aside) if s.getPath().getName().startswith("part-"))
        plain = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            # Renaming without the option to overwrite is one step that only one of two writers can make.
            hadoop.FileContext.getFileContext(target.toUri(), conf).rename(written, target, plain)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        finally:
            files.delete(aside, True)

    def was_published(self, label: str) -> bool:
        """Whether a version with this label exists, to skip work that is repeated."""
        try:
            log = self.spark.read.schema(_PUBLISHED_SCHEMA).parquet(f"{self.root}/{PUBLISHED}")
            return not log.where(F.col("etiqueta") == label).isEmpty()
        except AnalysisException:
            return False

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Publish what the block writes when it ends, and forget it if the block fails.

        Nothing that was pending before is taken along.
        """
        self.discard()
        try:
            yield
            self.publish()
        except BaseException:
            self.discard()
            raise

    def compact(self, table: str, most_folders: int = 32) -> bool:
        """Write a table with more folders anew as one, with the same rows; whether it was.

        Of a table in parts only those with more folders are written anew.
        """
        folders = self._folders(table)
        if self._part(table):
            held = Counter(_part_of(f) for f in folders)
            crowded = [part for part, count in held.items() if count > most_folders]
            if crowded:
                self.replace_parts(table, self.read_parts(table, crowded), crowded)
            return bool(crowded)
        if len(folders) <= most_folders:
            return False
        self.replace(table, self._open(table, folders))
        return True

    def discard(self) -> None:
        """Forget what was written and not published, and read the state afresh."""
        self._pending.clear()
        self._tops.clear()
        self._state, self._written = None, 0


def bucket(column: str, buckets: int) -> str:
    """The bucket of a row by the hash of a key."""
    return f"pmod(xxhash64({column}), {buckets})"


def _part_of(folder: str) -> int | None:
    found = re.search(rf"/{_PART}=(-?\d+)$", folder)
    return int(found[1]) if found else None


def _in_parts(folder: str, values: Sequence[int]) -> bool:
    return _part_of(folder) in set(values)
