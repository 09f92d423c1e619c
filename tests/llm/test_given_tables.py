"""Queries on the given tables against plain versions of what they promise."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.staged import ODD_TEXTS, WORDS, frame
from llm.test_search_and_turns import plain_trie, trie_rows
from starloom.llm import neighbours, prefix_trie, token_counts
from starloom.llm.queries import QUERIES, rebuilt_turns, table
from starloom.session import new_folder

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain_nearest(rows, k=5):
    """The exact neighbours of every query in double precision."""
    sound = {i: v for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    keys = np.array(sorted(sound))
    vectors = np.array([sound[i] for i in keys.tolist()], dtype=np.float64)
    norms = np.sqrt((vectors**2).sum(axis=1))
    out = {}
    for at in np.flatnonzero(keys % 50 == 0):
        scores = vectors @ vectors[at] / (norms * norms[at])
        order = [i for i in np.lexsort((keys, -scores)) if i != at][:k]
        out[int(keys[at])] = [(int(keys[i]), scores[i]) for i in order]
    return out


def test_neighbours_of_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, LARGER, "embeddings").collect()]
    exact, found = plain_nearest(rows), {}
    for r in QUERIES["op2_nearest_neighbours"](spark, LARGER).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == exact.keys()
    hits = 0
    vectors = dict(rows)
    for query, nearest in found.items():
        assert len(nearest) == len(exact[query]) and nearest == sorted(nearest, key=lambda x: (-x[1], x[0]))
        for i, score in nearest:
            a, b = np.array(vectors[query], dtype=np.float64), np.array(vectors[i], dtype=np.float64)
            assert i != query and abs(score - a @ b / math.sqrt((a @ a) * (b @ b))) < 1e-12
        hits += len({i for i, _ in nearest} & {i for i, _ in exact[query]})
    assert hits >= 0.9 * sum(len(x) for x in exact.values())


def test_neighbours_of_repeated_queries(spark):
    """Of several vectors of a query id the same one asks, however the rows are dealt."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    queries = [(7, [float(i), 1.0, -1.0, 2.0]) for i in range(5)]
    schema = "id_evaluacion bigint, puntajes array<double>"
    given = spark.createDataFrame(rows, schema)
    answers = {
        tuple((r.neighbour_id, r.score) for r in neighbours.search(given, spark.createDataFrame(q, schema).repartition(n)).orderBy("rank").collect())
        for q, n in ((queries, 1), (queries[::-1], 3))
    }
    assert len(answers) == 1


def plain_rule(url):
    """Host, path and the longest fitting rule, by splitting the text."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    fits = []
    for rule, verdict in rules.items():
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_of_given_pages(spark):
    urls = {r.page_id: r.url for r in table(spark, FOLDER, "pages").collect()}
    rows = QUERIES["op1_url_filter"](spark, FOLDER).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_token_counts_of_odd_documents(spark, tmp_path):
    """Null and empty texts, repeated rows, very long texts and columns named like the results."""
    rows = list(enumerate(ODD_TEXTS)) + [(4, "Álgebra I")] * 2 + [(None, "sin clave")]
    df = frame(spark, rows).withColumns({"part": F.lit("x"), "document": F.lit(1), "key": F.lit(2), "text": F.lit("y"), "value": F.lit("z")})
    df.write.parquet(str(tmp_path / "rows"))
    path = new_folder(spark)
    places = token_counts.flatten(spark.read.parquet(str(tmp_path / "rows")), WORDS, path)
    counted = token_counts.count(spark, path, block_tokens=64).withColumn("part", token_counts.part_number())
    found = Counter((r.row_id, r.n_tokens) for r in counted.join(places, ["part", "document"]).collect())
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    assert found == Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_token_counts_of_no_documents(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "rows"))
    path = new_folder(spark)
    assert token_counts.flatten(spark.read.parquet(str(tmp_path / "rows")), WORDS, path).count() == 0
    assert token_counts.count(spark, path).count() == 0


def test_trie_of_given_conversations(spark):
    """Rebuilt conversations with plain lists, among them one without turns of its own place and missing bases."""
    own = {}
    for r in table(spark, FOLDER, "conversations").collect():
        own.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    found = [
        (r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in QUERIES["op13_prefix_trie"](spark, FOLDER).collect()
    ]
    assert sorted(found, key=repr) == plain_trie(rebuilt)


def test_rebuilt_conversations(spark):
    """Fewer turns than are taken over, an absent base, turns without a number, and conversations without an id."""
    rows = [(20, None, "user", "a"), (20, 1, None, "b"), (20, 2, "user", None)] + [(c, 0, "user", str(c)) for c in range(21, 45)]
    rows += [(c, t, "assistant", f"{c} {t}") for c in range(21, 45, 3) for t in range(1, 6)] + [(None, 0, "user", "x")]
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in own.items()}
    expected = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        expected[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert trie_rows(prefix_trie.build(*rebuilt_turns(given))) == plain_trie(expected)
