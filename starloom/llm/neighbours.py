"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, best bins first.

For the project's evaluations: ``id_evaluacion`` with its scores as a vector
(``puntajes``: lecturer, content, overall), or any table of vectors.

A tree is fitted on a bounded sample and every row is put into a leaf. A query
walks the tree through a priority queue, most similar node first, and visits as
many leaves as calibration asks for: the exact neighbours of a bounded sample of
queries are found among all rows, and visits are widened until the leaves visited
hold the share ``TARGET_RECALL`` of them. Leaves with many rows or many queries are
split into blocks; a block of queries meets a block of rows in one matrix product.

Vectors that are null, empty or zero, that hold a null, an infinite or no number,
or that have another length than most vectors take no part, neither as queries nor
as candidates. Of several vectors of one query id one asks. Scores are computed on the original vectors in double precision, equal
scores go to the smaller id. Repeated rows of one id count once each; a query meets
no row of its own id. With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.columns import by_slices, share, ship
from starloom.session import materialize

# Bounds of what the tree is fitted on, and of the queries that calibrate it.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000
CALIBRATION_QUERIES = 256
TARGET_RECALL, LEAST_RECALL = 0.97, 0.9
BRANCHES, ROUNDS, LEAST_LEAF_SAMPLE = 12, 6, 8
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024
RESULT = "query_id bigint, rank int, neighbour_id bigint, score double"


@dataclass
class Tree:
    """``children[node]`` are node numbers, none for a leaf; ``centres`` are unit vectors."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaf: dict[int, int] = field(default_factory=dict)

    def finish(self) -> Tree:
        self.leaf = {n: i for i, n in enumerate(n for n, c in enumerate(self.children) if not c)}
        return self

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf that each row ends in when it follows the most similar centre down."""
        at = np.zeros(len(unit), dtype=np.int64)
        open_ = [0] if self.children[0] else []
        while open_:
            node = open_.pop()
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            below = np.array(self.children[node])
            best = (unit[rows] @ np.stack([self.centres[b] for b in below]).T).argmax(axis=1)
            at[rows] = below[best]
            open_ += [int(b) for b in below if self.children[b]]
        return np.array([self.leaf.get(n, 0) for n in range(len(self.children))])[at]

    def order(self, unit: np.ndarray, sizes: np.ndarray, visits: int, rows: int) -> list[int]:
        """Leaves in best-bin-first order: at least ``visits`` of them, and more until they hold ``rows`` rows."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < visits or held < rows):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                found.append(self.leaf[node])
                held += int(sizes[found[-1]])
                continue
            for child in self.children[node]:
                heapq.heappush(queue, (-float(self.centres[child] @ unit), child))
        return found


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their length; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _clusters(unit: np.ndarray, branches: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means: the cluster of each row."""
    centres = unit[rng.choice(len(unit), branches, replace=False)]
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.stack([unit[own == c].sum(axis=0) for c in range(branches)])
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return (unit @ centres.T).argmax(axis=1)


def fit_tree(unit: np.ndarray, leaves: int) -> Tree:
    """A k-means tree with about so many leaves over a sample of unit vectors."""
    rng = np.random.default_rng(7)
    small = max(LEAST_LEAF_SAMPLE, -(-len(unit) // max(1, leaves)))
    tree = Tree([np.zeros(unit.shape[1])], [[]])
    todo = [(0, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= small:
            continue
        own = _clusters(unit[rows], min(BRANCHES, max(2, len(rows) // small)), rng)
        groups = [rows[own == c] for c in np.unique(own)]
        if len(groups) < 2:
            continue
        for group in groups:
            mean = unit[group].sum(axis=0)
            tree.centres.append(mean / max(float(np.sqrt(mean @ mean)), 1e-300))
            tree.children.append([])
            tree.children[node].append(len(tree.centres) - 1)
            todo.append((len(tree.centres) - 1, group))
    return tree.finish()


def _matrix(values: pa.Array | list) -> np.ndarray:
    values = values.to_pylist() if isinstance(values, pa.Array) else values
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(len(values), -1)


def _packed(vectors: pa.Array) -> pa.Array:
    return pa.array([np.asarray(v, dtype=np.float64).tobytes() for v in vectors.to_pylist()], pa.binary())


def _leaves(vectors: pa.Array, shared) -> pa.Array:
    return pa.array(shared.value.assign(_unit(_matrix(vectors))) if len(vectors) else [], pa.int32())


def _visits(vectors: pa.Array, shared, visits: int, rows: int) -> pa.Array:
    tree, sizes = shared.value
    units = _unit(_matrix(vectors)) if len(vectors) else []
    return pa.array([tree.order(u, sizes, visits, rows) for u in units], pa.list_(pa.int32()))


def _nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the positions and scores of its ``k`` nearest rows; equal scores to the smaller id."""
    units, query_units = _unit(rows), _unit(queries)
    rough = query_units @ units.T
    for i, query_id in enumerate(query_ids):
        near = np.where(ids == query_id, -np.inf, rough[i])
        usable = int((near > -np.inf).sum())
        if not usable:
            continue
        least = np.partition(near, len(near) - min(k, usable))[len(near) - min(k, usable)]
        close = np.flatnonzero(near >= least - 1e-9)
        close = close[near[close] > -np.inf]
        # The product above may round equal rows differently; this does not.
        exact = (units[close] * query_units[i]).sum(axis=1)
        order = np.lexsort((ids[close], -exact))[:k]
        yield int(query_id), close[order], exact[order]


def _exact_task(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """The nearest rows of a task for each of a few shared queries."""
    query_ids, queries = shared.value
    out: list[list] = [[], [], [], []]
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("key").to_numpy(zero_copy_only=False)
        leaves = batch.column("leaf").to_numpy(zero_copy_only=False)
        for query, at, score in _nearest(query_ids, queries, ids, _matrix(batch.column("vector")), k):
            for part, values in zip(out, ([query] * len(at), ids[at], leaves[at], score), strict=True):
                part.extend(values)
    yield _batch(out, [("query_id", pa.int64()), ("key", pa.int64()), ("leaf", pa.int32()), ("score", pa.float64())])


def _batch(columns: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _meet_task(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries and rows, lying one after another with the queries first."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in groupby(rows, key=lambda r: r[:3]):
        sides: tuple[tuple[list, list], tuple[list, list]] = (([], []), ([], []))
        for _, _, _, is_row, key, vector in group:
            sides[is_row][0].append(key)
            sides[is_row][1].append(vector)
        (query_ids, queries), (ids, vectors) = sides
        if not query_ids or not ids:
            continue
        own, out = np.array(ids, dtype=np.int64), [[], [], []]
        for query, at, score in _nearest(np.array(query_ids, dtype=np.int64), _matrix(queries), own, _matrix(vectors), k):
            for part, values in zip(out, ([query] * len(at), own[at], score), strict=True):
                part.extend(values)
        yield _batch(out, [("query_id", pa.int64()), ("neighbour_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    """Whether a vector has only finite numbers, and one that is not 0."""
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, value) & F.exists(vector, lambda x: x != 0)


def _best(df: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(by))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _calibrated(placed: DataFrame, asked: DataFrame, tree: Tree, sizes: np.ndarray, k: int, target: float) -> tuple[int, float]:
    """The fewest leaf visits that reach the recall, and the recall they have on the sample of queries."""
    total = asked.count()
    share_ = min(1.0, CALIBRATION_QUERIES / max(1, total))
    drawn = asked.where(F.pmod(F.xxhash64(F.lit("calibrate"), F.col("key")), F.lit(1 << 30)) < share_ * (1 << 30)).select("key", "vector").toArrow()
    if not len(drawn):
        return len(sizes), 1.0
    ids, queries = drawn.column("key").to_numpy(), _matrix(drawn.column("vector").to_pylist())
    shared = share(placed.sparkSession, (ids, queries))
    found = placed.select("key", "leaf", "vector").mapInArrow(partial(_exact_task, shared=shared, k=k), "query_id bigint, key bigint, leaf int, score double")
    true = _best(found, k, "key").select("query_id", "leaf").collect()
    place = {int(i): {leaf: n for n, leaf in enumerate(tree.order(u, sizes, len(sizes), 0))} for i, u in zip(ids, _unit(queries), strict=True)}
    needed = np.sort([place[row["query_id"]][row["leaf"]] + 1 for row in true])
    if not len(needed):
        return len(sizes), 1.0
    visits = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])
    return visits, float((needed <= visits).mean())


def search(
    df: DataFrame,
    queries: DataFrame,
    key: str = "id_evaluacion",
    vector: str = "puntajes",
    k: int = 5,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """The ``k`` nearest rows of ``df`` found for every row of ``queries``: ``query_id``, ``rank``, ``neighbour_id``, ``score``."""
    spark = ship(df.sparkSession)
    pack = by_slices(_packed, "binary", lambda batch: iter([batch]))

    def sound(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v"))
        return named.where(F.col("key").isNotNull() & usable(F.col("v")))

    lengths = sound(df).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    size, total = lengths["n"], lengths["count"]
    of_size = lambda rows: sound(rows).where(F.size("v") == size).select("key", pack(F.col("v")).alias("vector"))
    # Rows that repeat an id are told apart by a number, so that samples and blocks keep their bounds.
    vectors = materialize(of_size(df).withColumn("row", F.monotonically_increasing_id()))
    share_ = min(1.0, min(SAMPLE_ROWS, SAMPLE_NUMBERS / size) / total)
    sample = vectors.where(F.pmod(F.xxhash64(F.lit("tree"), "key", "row"), F.lit(1 << 30)) < share_ * (1 << 30)).select("key", "vector").toArrow()
    sample = sample.sort_by("key")
    rows = _matrix(sample.column("vector").to_pylist()) if len(sample) else np.ones((1, size))
    tree = fit_tree(_unit(rows), leaves=int(total**0.5))
    leaf = by_slices(partial(_leaves, shared=share(spark, tree)), "int", lambda batch: iter([batch]))
    placed = materialize(vectors.select("key", "row", "vector", leaf(F.col("vector")).alias("leaf")))
    sizes = np.zeros(len(tree.leaf), dtype=np.int64)
    for row in placed.groupBy("leaf").count().collect():
        sizes[row["leaf"]] = row["count"]

    # Of several vectors of a query id the smallest by its bytes asks, whichever task comes first.
    asked = materialize(of_size(queries).groupBy("key").agg(F.min("vector").alias("vector")))
    visits, recall = _calibrated(placed, asked, tree, sizes, k, target_recall)
    if recall < LEAST_RECALL:
        raise RuntimeError(f"the tree finds {recall:.3f} of the exact neighbours of its calibration queries")
    walk = by_slices(partial(_visits, shared=share(spark, (tree, sizes)), visits=visits, rows=k + 1), "array<int>", lambda batch: iter([batch]))
    visiting = materialize(asked.select("key", "vector", F.explode(walk(F.col("vector"))).alias("leaf")))
    callers = np.zeros(len(sizes), dtype=np.int64)
    for row in visiting.groupBy("leaf").count().collect():
        callers[row["leaf"]] = row["count"]

    # Both tables have one entry per leaf, which the sample bounds.
    row_blocks = F.element_at(F.array(*[F.lit(int(max(1, -(-n // BLOCK_ROWS)))) for n in sizes]), F.col("leaf") + 1)
    query_blocks = F.element_at(F.array(*[F.lit(int(max(1, -(-n // BLOCK_QUERIES)))) for n in callers]), F.col("leaf") + 1)
    own_block = lambda blocks, *by: F.pmod(F.xxhash64(*by), blocks).cast("int")
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    cells = ["leaf", "row_block", "query_block"]
    right = placed.select("leaf", own_block(row_blocks, "key", "row").alias("row_block"), every_block(query_blocks).alias("query_block"), F.lit(1).alias("side"), "key", "vector")
    left = visiting.select("leaf", every_block(row_blocks).alias("row_block"), own_block(query_blocks, "key").alias("query_block"), F.lit(0).alias("side"), "key", "vector")
    met = left.unionByName(right).repartition(*cells).sortWithinPartitions(*cells, "side", "key")
    found = met.mapInArrow(partial(_meet_task, k=k), "query_id bigint, neighbour_id bigint, score double")
    return _best(found, k, "neighbour_id").select("query_id", "rank", "neighbour_id", "score")
