"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

The project resolves repeated identities by equal keys; this resolves records
with nearly equal texts (``nombre_raw`` of staged rows) and gives the same kind
of map: ``id_tomado``, the smallest id of a group, for every id.

Two records are linked if their sets of five-word runs have an intersection of at
least ``percent`` of their union. A text with fewer words is one run; null texts
and texts without a word have no run and are linked with nothing. Rows with one
id count as one record. Rows with a null id are in no group and stay.

How pairs are found without forming all of them: equal sets are one class; classes
that share a band of the signature are candidates, and the components of the
candidate graph cut the classes into clusters. Inside a cluster, blocks of bounded
size are compared with each other by one matrix product on their full sets, and
only a spanning forest of the links leaves a task. No bucket is capped. A link of
similarity 0.85 shares no band with probability (1 - 0.85^8)^48 < 3e-7. For a lower
``percent`` narrower bands keep that chance: (1 - 0.80^6)^48 < 5e-7 at 0.80.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.columns import by_slices, ship, struct_array
from starloom.llm.components import components
from starloom.llm.shingles import band_keys, shingle_sets, signatures
from starloom.llm.words import mixed, boundaries, group_sums, slices
from starloom.session import materialize

PERCENT = 85
BANDS, PER_BAND = 48, 8
# A block of a cluster has about so many classes and so many runs at most.
BLOCK_CLASSES, BLOCK_SHINGLES = 1_000, 2_000_000
# Columns of the membership matrix that are held at once.
COLUMNS = 4_096
# Bytes of text that a task hashes at once.
RUN_BYTES = 3_000_000


def _sketch(texts: pa.Array, per_band: int) -> pa.Array:
    elements, counts = shingle_sets(texts)
    keys = band_keys(signatures(elements, counts, BANDS * per_band), BANDS, per_band).view(np.int64)
    digests = [group_sums(mixed(elements ^ np.uint64(salt)), counts).view(np.int64) for salt in (0x1F83D9AB, 0x5BE0CD19)]
    offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS)
    return struct_array(
        n_shingles=pa.array(counts),
        digest=pa.array(digests[0]),
        digest2=pa.array(digests[1]),
        bands=pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
    )


def _sets(texts: pa.Array) -> pa.Array:
    elements, counts = shingle_sets(texts)
    bounds = boundaries(counts)
    return pa.array([elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked sets, one of the pair out of ``left`` and one out of ``right``."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    elements, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1
    common = (often > 1)[number]
    row, column = np.repeat(np.arange(len(sets)), sizes)[common], shared[number][common]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        member = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - start)), dtype=np.float32)
        member[row[a:b], column[a:b] - start] = 1
        both += (member[left] @ member[right].T).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    i, j = np.nonzero(100 * both >= percent * union)
    return left[i], right[j]


def forest(size: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each position that is not the first of its component, with that first one (union-find)."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in range(size) if root(x) != x]


def _verify_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links inside groups of rows that lie one after another: a block with itself, or two blocks."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for (_, first, second), group in groupby(rows, key=lambda r: r[:3]):
        ids, blocks, sets = [], [], []
        for _, _, _, block, class_id, runs in group:
            ids.append(class_id)
            blocks.append(block)
            sets.append(np.frombuffer(runs, dtype=np.uint64))
        left = np.flatnonzero(np.array(blocks) == first)
        right = np.flatnonzero(np.array(blocks) == second)
        if len(ids) < 2 or not len(left) or not len(right):
            continue
        pairs = linked_pairs(sets, left, right, percent)
        links = forest(len(ids), zip(*(p.tolist() for p in pairs), strict=True))
        if links:
            a, b = zip(*((ids[x], ids[y]) for x, y in links), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _candidates(classes: DataFrame) -> DataFrame:
    """Classes with another class of a bucket they share; only a star per bucket."""
    rows = classes.select(F.col("key").alias("a"), F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most")
    # Written down, so that both sides of the join are plain shuffles and a hot bucket can be split.
    return rows.join(materialize(buckets.select("bucket", "b")), "bucket").where("a <> b").select("a", "b")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members of clusters with the pairs of blocks they take part in."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("classes"), F.sum("n_shingles").alias("runs"))
    blocks = F.ceil(F.greatest(F.col("classes") / BLOCK_CLASSES, F.col("runs") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(sizes.select("cluster", blocks.alias("blocks")), "cluster").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return placed.select("cluster", "key", "block", other).select(
        "cluster", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "key"
    )


def find(
    df: DataFrame,
    key: str = "row_id",
    text: str = "nombre_raw",
    percent: int = PERCENT,
    per_band: int = PER_BAND,
    also: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``id_tomado`` and ``kept`` (the id is the one taken).

    ``per_band`` values make a band: the fewer, the less similar are the pairs that still share one.
    Columns named in ``also`` are carried along.
    """
    ship(df.sparkSession)
    runs_of_text = partial(slices, most=RUN_BYTES)
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"), *also)
    sketch = by_slices(partial(_sketch, per_band=per_band), "n_shingles bigint, digest bigint, digest2 bigint, bands array<bigint>", runs_of_text)
    sketches = materialize(rows.select("key", *also, sketch(F.col("text")).alias("s")).select("key", *also, "s.*"))

    equal = ["digest", "digest2", "n_shingles"]
    filled = sketches.where("n_shingles > 0 and key is not null")
    classes = materialize(filled.groupBy(*equal).agg(F.min("key").alias("class_id")))
    first = filled.join(classes.select(F.col("class_id").alias("key"), *equal), ["key", *equal], "left_semi")
    clusters = components(_candidates(first))
    members = clusters.select(F.col("a").alias("key"), F.col("b").alias("cluster"))
    members = members.unionByName(clusters.select(F.col("b").alias("key"), F.col("b").alias("cluster")).distinct())
    placed = _in_blocks(members.join(first.select("key", "n_shingles").distinct(), "key"))

    texts = rows.select("key", "text").join(members.select("key"), "key", "left_semi").distinct()
    runs = materialize(texts.select("key", by_slices(_sets, "binary", runs_of_text)(F.col("text")).alias("runs")))
    groups = placed.join(runs, "key").select("cluster", "first", "second", "block", "key", "runs")
    dealt = groups.repartition("cluster", "first", "second").sortWithinPartitions("cluster", "first", "second", "key")
    links = dealt.mapInArrow(partial(_verify_task, percent=percent), "a bigint, b bigint")

    taken = components(links).select(F.col("a").alias("class_id"), F.col("b").alias("root"))
    resolved = classes.join(taken, "class_id", "left").select(*equal, F.coalesce("root", "class_id").alias("taken"))
    own = F.when(F.col("key").isNotNull() & (F.col("n_shingles") > 0), F.col("taken"))
    return (
        sketches.drop("bands")
        .join(resolved, equal, "left")
        .select("key", *also, "n_shingles", F.coalesce(own, "key").alias("id_tomado"))
        .withColumn("kept", F.coalesce(F.col("key") == F.col("id_tomado"), F.lit(True)))
        .withColumnRenamed("key", key)
    )


def repeated(found: DataFrame, key: str = "row_id") -> DataFrame:
    """The map of repeated ids, as the project keeps it: ``id_repetido`` to ``id_tomado``."""
    return found.where(~F.col("kept")).select(F.col(key).alias("id_repetido"), "id_tomado").distinct()
