"""Prefix trie of sequences by sorted neighbours: sparse-table range minima, no stack.

The signature names the project's cleaned exams: an enrollment (``id_inscripcion``) is a
sequence, its attempts (``numero_intento``) the turns, and a turn is its result and grade
(``resultado``, ``nota``). Conversations of roles and texts work the same way. A node is a
distinct sequence of first turns; its members are the sequences that start with it.

Every turn becomes a 128-bit code, so texts are scanned and never shuffled. Sequences of
codes are sorted over the cluster, where the members of a node are neighbours. Blocks of
neighbours are worked on by numpy: the common length of each sequence with the one before
it (LCP) goes into a sparse table of range minima, and each candidate prefix searches its
left and right extent in it by halving steps, all candidates at once and none depending on
another. Counts of a node are differences of running sums over its extents; its parent is
the candidate one turn shorter, found at that one's left extent. Nodes that reach over the
edge of a block are summed up afterwards by a digest of their prefix.

Turns are ordered by turn (null first), then by their code; null roles and texts are empty;
repeated and tied rows are turns each. Rows without a sequence id belong to no sequence. A
block is bounded in sequences and turns; one sequence with its codes is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.columns import share
from starloom.llm.words import ranges
from starloom.session import materialize

# A code has so many bytes, and a block at most so many sequences and turns.
CODE_BYTES = 16
BLOCK_SEQUENCES, BLOCK_TURNS = 100_000, 500_000

NODE_SCHEMA = (
    "node string, parent string, depth bigint, first_id bigint, parent_first_id bigint, members bigint, children bigint, "
    "leaves bigint, shared bigint, before bigint, open boolean, parent_open boolean, part bigint, ends array<bigint>"
)


def word_count(text: Column) -> Column:
    """The number of words: runs of characters other than space and the controls 9 to 13."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def coded(
    rows: DataFrame, key: str = "id_inscripcion", turn: str = "numero_intento", role: str = "resultado", text: str = "nota"
) -> DataFrame:
    """One row per turn: ``key``, ``turn``, ``code`` (of role and text) and ``words`` of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    # The length of the role keeps role and text apart.
    whole = F.concat_ws("", F.length(role).cast("string"), F.lit(":"), role, text)
    code = F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * CODE_BYTES)
    return rows.select(F.col(key).cast("bigint").alias("key"), F.col(turn).alias("turn"), code.alias("code"), word_count(text).alias("words"))


def common_lengths(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many first codes each sequence shares with the one before it; 0 for the first one."""
    out = np.zeros(len(lengths), dtype=np.int64)
    both = np.minimum(lengths[1:], lengths[:-1])
    out[1:] = both
    filled = np.flatnonzero(both)
    if len(filled):
        own = ranges(starts[1:][filled], both[filled])
        other = ranges(starts[:-1][filled], both[filled])
        place = ranges(np.zeros(len(filled), dtype=np.int64), both[filled])
        differs = (codes[own] != codes[other]).any(axis=1)
        at = np.where(differs, place, np.iinfo(np.int64).max)
        firsts = np.cumsum(both[filled]) - both[filled]
        out[1 + filled] = np.minimum(both[filled], np.minimum.reduceat(at, firsts))
    return out


class SparseTable:
    """Range minima of an array: level ``k`` holds the least of every ``2^k`` neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value from ``first`` to ``last``, both included."""
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        level = np.floor(np.log2(last - first + 1)).astype(np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << int(k)) + 1])
        return out

    def right_extent(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place that ``at`` reaches over values of at least ``depth`` behind it."""
        place = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            free = place + 1 < len(level)
            step = free & (level[np.where(free, place + 1, 0)] >= depth)
            place += step.astype(np.int64) << k
        return place

    def left_extent(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place that is reached from ``at`` over values of at least ``depth``, its own included."""
        place = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            start = place - (1 << k) + 1
            free = start > 0
            step = free & (level[np.where(free, start, 0)] >= depth)
            place -= step.astype(np.int64) << k
        return place


def _chain(codes: np.ndarray) -> list[str]:
    """A digest of the first 0, 1, 2, ... codes of a sequence."""
    state = blake2b(digest_size=CODE_BYTES)
    out = [state.hexdigest()]
    for code in codes:
        state.update(code.tobytes())
        out.append(state.hexdigest())
    return out


@dataclass
class Block:
    """Neighbouring sequences: ids, how many turns each has, and codes and words of all turns one after another."""

    name: str
    number: int
    ids: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    words: np.ndarray


def block_nodes(block: Block, before: int, after: int) -> pa.RecordBatch:
    """The nodes of a block, given how many turns its first and last sequence share with their neighbours outside.

    -1 stands for no neighbour. Of nodes that reach over an edge the block gives its part.
    """
    ids, lengths, size = block.ids, block.lengths, len(block.ids)
    starts = np.cumsum(lengths) - lengths
    lcp = common_lengths(block.codes, starts, lengths)
    table, least_id = SparseTable(lcp), SparseTable(ids)

    # Candidates: every prefix that the sequence before does not have; the first sequence names all of its own.
    opened = np.concatenate(([-1], lcp[1:]))
    news = lengths - opened
    base = np.cumsum(news) - news
    row = np.repeat(np.arange(size), news)
    depth = opened[row] + 1 + ranges(np.zeros(size, dtype=np.int64), news)
    left, right = table.left_extent(row, depth), table.right_extent(row, depth)
    first_id = least_id.least(left, right)

    # The parent is a candidate of the same sequence, or of the left extent of the prefix one turn shorter.
    shorter = np.maximum(depth - 1, 0)
    owner = table.left_extent(row, shorter)
    parent = base[owner] + shorter - (opened[owner] + 1)
    parent[depth == 0] = -1

    cumulated = np.concatenate(([0], np.cumsum(block.words)))
    known = np.concatenate(([max(before, 0)], lcp[1:]))
    shared = np.concatenate(([0], np.cumsum(cumulated[starts + known] - cumulated[starts])))
    continued = (row == 0) & (depth <= before)
    total_shared = shared[right + 1] - shared[np.where(continued, left, left + 1)]
    following = np.concatenate((lcp[1:], [after]))
    ends_leaf = np.concatenate(([0], np.cumsum(following < lengths)))
    counted = parent[(parent >= 0) & ~continued]
    children = np.bincount(counted, minlength=len(row))

    open_left, open_right = continued, (right == size - 1) & (depth <= after)
    is_open = open_left | open_right
    names = np.array([f"{block.name}-{r}-{d}" for r, d in zip(row.tolist(), depth.tolist(), strict=True)], dtype=object)
    for at, mask in ((size - 1, open_right), (0, open_left)):
        if mask.any():
            chain = np.array(_chain(block.codes[starts[at] : starts[at] + lengths[at]]), dtype=object)
            names[mask] = chain[depth[mask]]

    # Equal sequences lie together, sorted by id, at the start of their node.
    runs = np.flatnonzero(np.concatenate(([True], (lcp[1:] < lengths[1:]) | (lengths[1:] != lengths[:-1]))))
    run_ends = np.append(runs[1:], size)
    end_node = base[table.left_extent(runs, lengths[runs])] + lengths[runs]
    end_node -= opened[table.left_extent(runs, lengths[runs])] + 1
    count = np.zeros(len(row), dtype=np.int64)
    count[end_node] = run_ends - runs
    begin = np.zeros(len(row), dtype=np.int64)
    begin[end_node] = runs
    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[ranges(begin, count)]))

    held = np.maximum(parent, 0)
    root = parent < 0
    parents = np.where(root, None, names[held])
    columns = {
        "node": pa.array(names, pa.string()),
        "parent": pa.array(parents, pa.string()),
        "depth": pa.array(depth),
        "first_id": pa.array(first_id),
        "parent_first_id": pa.array(first_id[held], mask=root | is_open[held]),
        "members": pa.array(right - left + 1),
        "children": pa.array(children.astype(np.int64)),
        "leaves": pa.array(ends_leaf[right + 1] - ends_leaf[left]),
        "shared": pa.array(total_shared),
        "before": pa.array(cumulated[starts[row] + shorter] - cumulated[starts[row]]),
        "open": pa.array(is_open),
        "parent_open": pa.array(~root & is_open[held]),
        "part": pa.array(np.full(len(row), block.number, dtype=np.int64)),
        "ends": ends,
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _arrays(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = pa.Table.from_batches(batches)
    ids = rows.column("key").to_numpy()
    joined = b"".join(rows.column("codes").to_pylist())
    codes = np.array(bytearray(joined), dtype=np.uint8).view(np.uint64).reshape(-1, CODE_BYTES // 8)
    words = rows.column("words").combine_chunks()
    lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, lengths, codes, flat


def shared_turns(a: bytes, b: bytes) -> int:
    """The number of first codes that two sequences share."""
    size = min(len(a), len(b)) // CODE_BYTES
    left, right = (np.frombuffer(x[: size * CODE_BYTES], dtype=np.uint64).reshape(-1, 2) for x in (a, b))
    other = np.flatnonzero((left != right).any(axis=1))
    return int(other[0]) if len(other) else size


def _cut(batches: Iterator[pa.RecordBatch], most_sequences: int, most_turns: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task in pieces of one partition of the sort and bounded size."""
    for batch in batches:
        part = batch.column(0).to_numpy()
        turns = np.cumsum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(part):
            same = int(np.searchsorted(part[start:], part[start], side="right"))
            before = turns[start - 1] if start else 0
            fits = int(np.searchsorted(turns, before + most_turns, side="right")) - start
            length = max(1, min(same, fits, most_sequences))
            yield int(part[start]), batch.slice(start, length)
            start += length


def _block_task(batches: Iterator[pa.RecordBatch], edges, most_sequences: int, most_turns: int) -> Iterator[pa.RecordBatch]:
    """The nodes of each block; a partition of the sort that is too big for one block is cut into several."""
    held: list[pa.RecordBatch] = []
    size = turns = number = 0
    current, before = None, -1

    def closed(after: int) -> pa.RecordBatch:
        ids, lengths, codes, words = _arrays(held)
        return block_nodes(Block(f"{current}.{number}", (current << 24) + number, ids, lengths, codes, words), before, after)

    for part, piece in _cut(batches, most_sequences, most_turns):
        count = int(pc.sum(pc.list_value_length(piece.column(3))).as_py() or 0)
        if held and part != current:
            yield closed(edges.value[current][1])
            held, size, turns, number = [], 0, 0, 0
        elif held and (size + len(piece) > most_sequences or turns + count > most_turns):
            common = shared_turns(held[-1].column(2)[len(held[-1]) - 1].as_py(), piece.column(2)[0].as_py())
            yield closed(common)
            held, size, turns, number, before = [], 0, 0, number + 1, common
        if part != current:
            current, before = part, edges.value[part][0]
        held.append(piece)
        size, turns = size + len(piece), turns + count
    if held:
        yield closed(edges.value[current][1])


def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else shared_turns(x, y) for x, y in pairs], pa.int64())


def sorted_sequences(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``key``, ``codes`` and ``words`` of every sequence, sorted over the cluster, with the ``part`` of the sort each is in.

    ``ids`` are further ids, of sequences that may have no turn.
    """
    given = turns.select("key", F.struct("turn", "code", "words").alias("t"))
    if ids is not None:
        absent = F.lit(None).cast(given.schema["t"].dataType)
        given = given.unionByName(ids.select(F.col(ids.columns[0]).cast("bigint").alias("key"), absent.alias("t")))
    grouped = given.where("key is not null").groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("t"))
    codes = F.unhex(F.array_join(F.transform("t", lambda t: t.code), ""))
    rows = grouped.select("key", codes.alias("codes"), F.transform("t", lambda t: t.words).alias("words"))
    dealt = rows.repartitionByRange("codes", "key").sortWithinPartitions("codes", "key")
    # Written down: a repeated task must find the same rows in the same part.
    return materialize(dealt.select(F.spark_partition_id().alias("part"), "key", "codes", "words"))


def _edges(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each part of the sort, the turns shared over its lower and its upper edge; two numbers a part."""
    ends = F.struct("codes", "key")
    parts = rows.groupBy("part").agg(F.min(ends).alias("low"), F.max(ends).alias("high"))
    # One row per partition of the sort, so one task can order them.
    order = Window.orderBy("part")
    beside = parts.select("part", "low.codes", F.lag("high.codes").over(order).alias("earlier"))
    found = beside.select("part", F.coalesce(F.arrow_udf(_shared, "bigint")("earlier", "codes"), F.lit(-1)).alias("shared")).orderBy("part").collect()
    after = [*[row.shared for row in found], -1][1:]
    return {row.part: (row.shared, a) for row, a in zip(found, after, strict=True)}


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per node; ``ends``: the ids of the sequences that are just the node, in rows of ascending ``part``."""

    nodes: DataFrame
    ends: DataFrame


def build(turns: DataFrame, ids: DataFrame | None = None, most_sequences: int = BLOCK_SEQUENCES, most_turns: int = BLOCK_TURNS) -> Trie:
    """The trie of coded turns (see ``coded``) and further sequence ids.

    ``nodes`` has ``node`` and ``parent`` (names), ``depth``, ``first_id`` (the smallest id of a
    member), ``parent_first_id``, ``members``, ``children``, ``leaves`` (childless nodes below or
    the node itself) and ``saved_tokens``: over the node and all below it, the words of the last
    turn for each member but one. Without any sequence there is no node, not even a root.
    """
    rows = sorted_sequences(turns, ids)
    edges = share(rows.sparkSession, _edges(rows))
    dealt = rows.repartition("part").sortWithinPartitions("part", "codes", "key").select("part", "key", "codes", "words")
    found = materialize(dealt.mapInArrow(partial(_block_task, edges=edges, most_sequences=most_sequences, most_turns=most_turns), NODE_SCHEMA))
    edges.destroy()

    plain = ["node", "parent", "depth", "first_id", "parent_first_id", "members", "children", "leaves", "shared", "before", "parent_open"]
    reaching = found.where("open").groupBy("node").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("parent", "depth", "before")],
        F.min("first_id").alias("first_id"),
        F.lit(None).cast("bigint").alias("parent_first_id"),
        *[F.sum(c).alias(c) for c in ("members", "children", "leaves", "shared")],
        F.lit(True).alias("parent_open"),
    )
    reaching = materialize(reaching.select(plain))
    names = reaching.select(F.col("node").alias("parent"), F.col("first_id").alias("_first"))
    nodes = found.where("not open").select(plain)
    settled = nodes.where("not parent_open")
    asking = nodes.where("parent_open").unionByName(reaching).join(names, "parent", "left")
    resolved = asking.withColumn("parent_first_id", F.col("_first")).select(plain)
    saved = (F.col("shared") - (F.col("members") - 1) * F.col("before")).alias("saved_tokens")
    nodes = settled.unionByName(resolved).select(*plain[:8], saved)
    return Trie(nodes, found.where(F.size("ends") > 0).select("node", "part", "ends"))


def _digest_task(batches: Iterator[pa.RecordBatch], digest: str) -> Iterator[pa.RecordBatch]:
    """A checksum of the ids of each node, which lie one after another."""
    from hashlib import new

    node, state = None, None
    for batch in batches:
        names, sums = [], []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if name != node:
                if state is not None:
                    names.append(node)
                    sums.append(state.hexdigest())
                node, state = name, new(digest)
            else:
                state.update(b",")
            state.update(",".join(map(str, ids.values.to_numpy().tolist())).encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.string())], ["node", "ends_digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_digest"])


def ends_digests(trie: Trie, digest: str = "sha256") -> DataFrame:
    """``node`` and ``ends_digest``: a checksum of the ids that end there, ascending and joined by commas.

    A node with very many ends is read in rows of a block's ids each, and only its checksum's state is kept.
    """
    dealt = trie.ends.repartition("node").sortWithinPartitions("node", "part")
    return dealt.mapInArrow(partial(_digest_task, digest=digest), "node string, ends_digest string")
