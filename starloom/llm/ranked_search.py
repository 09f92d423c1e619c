"""Ranked lexical search by the Best Position Algorithm over impact lists.

For the project's staged texts: ranks the rows of a staging table (``row_id`` and a text such
as the ``nombre_raw`` of courses) for each of many requests, which are staged rows as well.

Terms are runs of digits, letters A-Z in either case (taken as small ones) and characters
beyond ASCII. The score of a row for a request is the sum over the request's terms, repeats
included, of a term's impact in the row; impacts are whole numbers (see ``impacts``).

The texts are scanned once per block of requests, of which the terms are bounded and sent to
every task; only these terms' counts are written down. Rows are then dealt into index blocks
of bounded size, each ranked on its own: a term's postings are a list by falling impact. The
lists of a request are read in rounds from the top; every row that comes up is looked up in
all of the request's lists directly, which gives its score and marks its position in each.
The best position of a list is the last one before which all positions are marked; the
impacts there, added up, bound what an unseen row can score. Reading ends when that bound is
strictly below the k-th score, so rows with equal scores are never missed. The best rows of
the blocks are merged by a window that keeps k of each request before the shuffle.

Null texts have no term and are not counted. Every row is a document of its own, also when ids
repeat or are null (null ids come first among equal scores). Texts of requests that share an
id are one request; requests that repeat id and text count once. Requests without a term get
no row. Without documents there is no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.columns import release, share
from starloom.llm.words import Words, boundaries, slices, words_of
from starloom.session import materialize

BEST = 20
# Terms of a block of requests, and postings of an index block.
MOST_TERMS, MOST_POSTINGS = 200_000, 4_000_000
# Positions read from each list in the first round; every further round reads twice as many.
FIRST_READ = 64

# The characters that are in no term.
BETWEEN_TERMS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = ord(" ")
_BYTES[[ord(c) for c in _CAPITALS]] = [ord(c) for c in _SMALL]


def terms_of(texts: pa.Array) -> Words:
    """The terms of texts; ``texts`` is a large string column without null or offset."""
    _, offsets, data = texts.buffers()
    plain = _BYTES[np.frombuffer(data or b"", dtype=np.uint8)]
    return words_of(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(plain)]))


@dataclass(frozen=True)
class Requests:
    """A block of requests: the different terms, and per request its id, numbers of terms and how often each is in it."""

    terms: list[str]
    ids: list[int | None]
    lists: list[np.ndarray]
    often: list[np.ndarray]


def request_terms(requests: DataFrame, key: str, text: str) -> DataFrame:
    """``request``, ``term`` and ``n`` for every term of a request."""
    different = requests.select(F.col(key).cast("bigint").alias("request"), F.col(text).cast("string").alias("text")).distinct()
    lowered = F.translate(F.coalesce("text", F.lit("")), _CAPITALS, _SMALL)
    found = F.regexp_extract_all(lowered, F.lit(f"([^{BETWEEN_TERMS}]+)"), F.lit(1))
    return different.select("request", F.explode(found).alias("term")).groupBy("request", "term").agg(F.count(F.lit(1)).alias("n"))


def request_blocks(terms: DataFrame, most_terms: int) -> Iterator[Requests]:
    """The requests in blocks of about ``most_terms`` terms at most; one longer request is a block of its own."""
    sizes = terms.groupBy("request").agg(F.count(F.lit(1)).alias("terms"))
    total = sizes.agg(F.sum("terms").alias("terms"), F.count(F.lit(1)).alias("requests")).first()
    if not total.requests:
        return
    count = math.ceil(total.terms / most_terms)
    spread = F.xxhash64("request")
    while count > 1 and count < 4 * total.requests:
        held = sizes.groupBy(F.pmod(spread, F.lit(count))).agg(F.sum("terms").alias("n"), F.count(F.lit(1)).alias("m"))
        if held.where((F.col("n") > most_terms) & (F.col("m") > 1)).isEmpty():
            break
        count *= 2
    for block in range(count):
        rows = terms.where(F.pmod(spread, F.lit(count)) == block).toArrow().sort_by([("request", "ascending"), ("term", "ascending")])
        if not len(rows):
            continue
        coded = rows.column("term").combine_chunks().dictionary_encode()
        number, often = coded.indices.to_numpy().astype(np.int64), rows.column("n").to_numpy()
        ids = rows.column("request").to_pylist()
        starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
        spans = list(zip(starts[:-1], starts[1:], strict=True))
        yield Requests(
            coded.dictionary.to_pylist(), [ids[a] for a, _ in spans], [number[a:b] for a, b in spans], [often[a:b] for a, b in spans]
        )


def _count_task(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Per row with a term: its key, its number of terms, and which of the requests' terms it holds how often."""
    known = pa.array(shared.value, pa.large_string())
    for batch in batches:
        at = 0
        for texts in slices(batch.column(1)):
            words = terms_of(texts)
            keys = batch.column(0).slice(at, len(texts))
            at += len(texts)
            number = pc.fill_null(pc.index_in(words.distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = number[words.codes]
            asked = code >= 0
            owner = np.repeat(np.arange(len(texts)), words.counts)[asked]
            cells, often = np.unique(owner * len(known) + code[asked], return_counts=True)
            held = np.bincount(cells // max(1, len(known)), minlength=len(texts))
            offsets = pa.array(boundaries(held).astype(np.int32))
            rows = pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(words.counts),
                    pa.ListArray.from_arrays(offsets, pa.array((cells % max(1, len(known))).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(often.astype(np.int32))),
                ],
                ["key", "length", "terms", "often"],
            )
            yield rows.filter(pa.array(words.counts > 0))
        release()


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms, and the weight of each of the requests' terms."""

    documents: int
    terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, documents: int, terms: int, held_by: np.ndarray) -> Statistics:
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in held_by.tolist()]
        return cls(documents, terms, np.array(weights, dtype=np.int64))


def impacts(statistics: Statistics, term: np.ndarray, often: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term adds to the score of a row of so many terms in which it occurs so often."""
    damping = 100 - 25 + (25 * length * statistics.documents) // statistics.terms
    return statistics.weights[term] * ((1_000_000_000 * often) // (1000 * often + 12 * damping))


class ImpactLists:
    """The postings of an index block, by term: once by falling impact, once by document for direct access."""

    def __init__(self, document: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int, terms: int):
        order = np.lexsort((document, term))
        self.documents = documents
        self.bounds = np.searchsorted(term[order], np.arange(terms + 1))
        self.by_document, self.impact = document[order], impact[order]
        falling = np.lexsort((self.by_document, -self.impact, term[order]))
        self.ranked = self.by_document[falling]
        self.ranked_impact = self.impact[falling]
        self.position = np.empty(len(order), dtype=np.int64)
        self.position[falling] = np.arange(len(order))

    def best(self, lists: np.ndarray, often: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and documents of the ``k`` best rows with a score above 0, equal scores by document."""
        bounds = self.bounds
        spans = [(bounds[t], bounds[t + 1], n) for t, n in zip(lists.tolist(), often.tolist(), strict=True)]
        spans = [(a, b, n) for a, b, n in spans if b > a and self.ranked_impact[a] > 0]
        seen = np.zeros(self.documents, dtype=bool)
        marked = [np.zeros(b - a, dtype=bool) for a, b, _ in spans]
        best_position = [0] * len(spans)
        scores, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        depth, reads = 0, FIRST_READ
        while spans:
            # Sorted access: the next positions of every list.
            up = [self.ranked[a + depth : min(b, a + depth + reads)] for a, b, _ in spans]
            fresh = np.unique(np.concatenate(up))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            # Direct access: the new rows in all lists, for their scores and their positions.
            total = np.zeros(len(fresh), dtype=np.int64)
            for (a, b, n), marks in zip(spans, marked, strict=True):
                own = self.by_document[a:b]
                at = np.searchsorted(own, fresh)
                hit = np.flatnonzero((at < b - a) & (own[np.minimum(at, b - a - 1)] == fresh))
                total[hit] += n * self.impact[a + at[hit]]
                marks[self.position[a + at[hit]] - a] = True
            scores, found = np.concatenate((scores, total)), np.concatenate((found, fresh))
            order = np.lexsort((found, -scores))[:k]
            scores, found = scores[order], found[order]
            bound = 0
            for i, ((a, b, n), marks) in enumerate(zip(spans, marked, strict=True)):
                rest = marks[best_position[i] :]
                best_position[i] += len(rest) if rest.all() else int(np.argmin(rest))
                if best_position[i] < b - a:  # a row in no position left gets nothing from this list
                    bound += n * int(self.ranked_impact[a + best_position[i] - 1])
            if bound == 0 or (len(scores) == k and bound < scores[-1]):
                break
            depth, reads = depth + reads, 2 * reads
        return scores[scores > 0], found[scores > 0]


def _rank_block(rows: pa.Table, requests: Requests, statistics: Statistics, k: int) -> pa.RecordBatch:
    rows = rows.take(pc.sort_indices(rows, [("key", "ascending")], null_placement="at_start"))
    held = pc.list_value_length(rows.column("terms")).to_numpy().astype(np.int64)
    document = np.repeat(np.arange(len(rows)), held)
    term = pc.list_flatten(rows.column("terms")).to_numpy().astype(np.int64)
    often = pc.list_flatten(rows.column("often")).to_numpy().astype(np.int64)
    length = rows.column("length").to_numpy()[document]
    index = ImpactLists(document, term, impacts(statistics, term, often, length), len(rows), len(requests.terms))
    ids, scores, found = [], [], []
    for request, lists, times in zip(requests.ids, requests.lists, requests.often, strict=True):
        score, place = index.best(lists, times, k)
        ids += [request] * len(score)
        scores.append(score)
        found.append(place)
    places = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    keys = rows.column("key").combine_chunks().take(pa.array(places, pa.int64()))
    values = np.concatenate(scores) if scores else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), keys, pa.array(values)], ["request", "key", "score"])


def _rank_task(batches: Iterator[pa.RecordBatch], shared, k: int, most_postings: int) -> Iterator[pa.RecordBatch]:
    requests, statistics = shared.value
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch) + len(batch.column(2).flatten())
        if size >= most_postings:
            yield _rank_block(pa.Table.from_batches(held), requests, statistics, k)
            held, size = [], 0
            release()
    if held:
        yield _rank_block(pa.Table.from_batches(held), requests, statistics, k)


def _search_block(texts: DataFrame, requests: Requests, k: int, most_postings: int) -> DataFrame | None:
    spark = texts.sparkSession
    terms = share(spark, requests.terms)
    counted = materialize(texts.mapInArrow(partial(_count_task, shared=terms), "key bigint, length bigint, terms array<int>, often array<int>"))
    terms.destroy()
    total = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("length").alias("terms")).first()
    if not total.documents:
        return None
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow()
    held_by = np.zeros(len(requests.terms), dtype=np.int64)
    held_by[held.column("term").to_numpy()] = held.column("n").to_numpy()
    shared = share(spark, (requests, Statistics.of(total.documents, total.terms, held_by)))
    ranked = counted.mapInArrow(
        partial(_rank_task, shared=shared, k=k, most_postings=most_postings), "request bigint, key bigint, score bigint"
    )
    order = Window.partitionBy("request").orderBy(F.col("score").desc(), F.col("key").asc_nulls_first())
    best = materialize(ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    shared.destroy()
    return best


def search(
    rows: DataFrame,
    requests: DataFrame,
    key: str = "row_id",
    text: str = "nombre_raw",
    request_key: str = "row_id",
    request_text: str = "nombre_raw",
    k: int = BEST,
    most_terms: int = MOST_TERMS,
    most_postings: int = MOST_POSTINGS,
) -> DataFrame:
    """The ``k`` best rows of each request: ``request``, ``rank`` (from 1), the row's ``key`` and ``score`` (above 0).

    Equal scores are ordered by key. More requests than fit a block of ``most_terms`` terms are
    ranked block after block, each with a scan of the texts.
    """
    texts = rows.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    terms = materialize(request_terms(requests, request_key, request_text))
    found = [_search_block(texts, block, k, most_postings) for block in request_blocks(terms, most_terms)]
    empty = rows.sparkSession.createDataFrame([], "request bigint, key bigint, score bigint, rank int")
    return reduce(DataFrame.unionByName, [best for best in found if best is not None] or [empty]).select("request", "rank", F.col("key").alias(key), "score")
