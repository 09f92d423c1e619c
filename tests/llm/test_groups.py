"""Near duplicates, nearest neighbours, URL filter and mixing."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.staged import ENGLISH, ODD_TEXTS, SPANISH, frame, odd_rows, sentence
from starloom.llm import mixing, near_duplicates, neighbours, url_filter
from starloom.llm.components import components
from starloom.llm.shingles import signatures


def runs(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_groups(rows):
    """Smallest id of each group, by all pairs."""
    sets = {i: runs(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(n=40, seed=1):
    rng = random.Random(seed)
    vocabulary = [a + b for a in SPANISH for b in ("", "s", "al", "ción")]
    rows = []
    for group in range(n):
        base = sentence(rng, vocabulary, rng.randint(1, 150)).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = base[:]
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words).title() if rng.random() < 0.5 else "  ".join(words))
    rng.shuffle(rows)
    return list(enumerate([*ODD_TEXTS, *rows]))


def found_groups(df, **options):
    return {r.row_id: (r.n_shingles, r.id_tomado) for r in near_duplicates.find(df, **options).collect()}


def test_near_duplicates_against_all_pairs(spark):
    rows = copies()
    assert found_groups(frame(spark, rows).repartition(5)) == plain_groups(rows)


def test_clusters_in_several_blocks(spark, monkeypatch):
    base = sentence(random.Random(9), SPANISH, 100).split()
    rows = [(i, " ".join([*base[: i % 97], f"distinto{i}", *base[i % 97 + 1 :]])) for i in range(60)]
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", 7)
    assert found_groups(frame(spark, rows)) == plain_groups(rows)


def test_near_duplicate_map_and_odd_rows(spark):
    df = odd_rows(spark).withColumn("kept", F.lit("x")).unionByName(odd_rows(spark).where("row_id = 4").withColumn("kept", F.lit("y")))
    found = near_duplicates.find(df)
    assert found.columns == ["row_id", "n_shingles", "id_tomado", "kept"] and found.count() == len(ODD_TEXTS) + 2
    rows = {r.row_id: r for r in found.collect()}
    assert rows[None].kept and rows[None].id_tomado is None
    assert all(rows[i].n_shingles == 0 and rows[i].id_tomado == i for i in (0, 1, 2))
    assert [tuple(r) for r in near_duplicates.repeated(found).collect()] == [(5, 4)]
    assert near_duplicates.find(df.limit(0)).isEmpty()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for size, common in ((3, 2), (40, 30), (3000, 1500)):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = np.concatenate((a[:common], rng.integers(0, 2**63, size - common, dtype=np.uint64)))
        first, second = signatures(np.concatenate((a, b)), np.array([size, size]), 2048)
        assert (first == second).mean() == pytest.approx(common / (2 * size - common), abs=0.05)
    empty = signatures(np.zeros(0, dtype=np.uint64), np.array([0, 0]), 16)
    assert (empty == np.iinfo(np.uint64).max).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(200, i) for i in range(201, 240)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r.a: r.b for r in components(df).collect()} == {x: r for x, r in root.items() if x != r}
    assert components(df.limit(0)).isEmpty()


def evaluations(spark, n=1500, seed=3):
    """Scores of course evaluations as vectors, with rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    vectors = centres[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1])] + [(n + 3 + i, [2 * x for x in rows[10][1]]) for i in range(30)]
    odd = [None, [], [0.0] * 6, [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [float("inf"), 0, 0, 0, 0, 1.0], [1.0, 2.0]]
    rows += [(9000 + 50 * i, v) for i, v in enumerate(odd)]
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id_evaluacion bigint, puntajes array<double>")


def test_nearest_against_all_rows(spark):
    df = evaluations(spark)
    found = neighbours.search(df, df.where("id_evaluacion % 50 = 0")).collect()
    sound = {r.id_evaluacion: np.array(r.puntajes) for r in df.collect() if r.id_evaluacion < 9000}
    ids = np.array(list(sound))
    unit = np.stack([v / np.sqrt(v @ v) for v in sound.values()])
    hits, asked = 0, [i for i in sound if i % 50 == 0]
    assert {r.query_id for r in found} == set(asked)
    for q in asked:
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in {r.neighbour_id for r in own}
        scores = unit @ unit[list(ids).index(q)]
        for r in own:
            assert r.score == pytest.approx(scores[list(ids).index(r.neighbour_id)], abs=1e-12)
        assert [(-r.score, r.neighbour_id) for r in own] == sorted((-r.score, r.neighbour_id) for r in own)
        order = sorted(range(len(ids)), key=lambda j: (-round(float(scores[j]), 12), ids[j]))
        hits += len({r.neighbour_id for r in own} & set([int(ids[j]) for j in order if ids[j] != q][:5]))
    assert hits >= 0.9 * 5 * len(asked)


def test_equal_vectors_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(100 + i, [float(i), 1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id_evaluacion bigint, puntajes array<double>")
    found = neighbours.search(df, df.where("id_evaluacion in (0, 20)")).orderBy("query_id", "rank").collect()
    assert [r.neighbour_id for r in found] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_blocks_of_rows_and_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    df = evaluations(spark, 300)
    whole = neighbours.search(df, df.where("id_evaluacion % 10 = 0"), target_recall=1.0)
    monkeypatch.undo()
    again = neighbours.search(df, df.where("id_evaluacion % 10 = 0"), target_recall=1.0)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect()))


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id_evaluacion bigint, puntajes array<double>")
    assert [(r.query_id, r["rank"], r.neighbour_id) for r in neighbours.search(df, df.where("id_evaluacion = 1")).orderBy("rank").collect()] == [(1, 1, 3), (1, 2, 2)]
    assert neighbours.search(df.limit(0), df).isEmpty()
    assert neighbours.search(df, df.limit(0)).isEmpty()
    assert neighbours.search(df.limit(1), df.limit(1)).isEmpty()


RULES = (
    url_filter.Rule("edu", "/", url_filter.ALLOW), url_filter.Rule("notas.edu", "/es/", url_filter.BLOCK),
    url_filter.Rule("www.notas.edu", "/es/", url_filter.ALLOW), url_filter.Rule("net", "/", url_filter.BLOCK),
)
URLS = {
    "http://notas.edu/es/1": ("notas.edu", "/es/1", "notas.edu/es/", "block"),
    "https://WWW.Notas.EDU/es/x?a=/b#c": ("www.notas.edu", "/es/x", "www.notas.edu/es/", "allow"),
    "https://m.notas.edu/es/": ("m.notas.edu", "/es/", "notas.edu/es/", "block"),
    "ftp://malnotas.edu/es/": ("malnotas.edu", "/es/", "edu/", "allow"),
    "http://notas.edu": ("notas.edu", "", None, None), "http://notas.edu?x=http://y.net/": ("notas.edu", "", None, None),
    "http://a.net/?q": ("a.net", "/", "net/", "block"), "notas.edu/es/": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
    "http://É.edu/\n?": ("É.edu", "/\n", "edu/", "allow"), "http:///p": ("", "/p", None, None), "x://" + "a" * 50_000 + ".org/": ("a" * 50_000 + ".org", "/", None, None),
}


def test_rules_hosts_and_paths(spark):
    df = spark.createDataFrame([(i, u, "old", "x") for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string, Rule string, entropy string")
    found = url_filter.judge(df, RULES, "url", "page_id")
    assert found.columns == ["page_id", "url", "entropy", "host", "path", "rule", "verdict", "score"] and found.count() == 2 * len(URLS)
    for r in found.collect():
        host, path, rule, verdict = URLS[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if verdict else r.verdict in {"allow", "block"}
        assert 0 <= r.score <= 1


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(5)
    good = [f"https://curso{rng.randint(1, 30)}.org/plan/{rng.choice(SPANISH)}" for _ in range(300)]
    bad = [f"http://x{rng.randint(10**9, 10**10)}.biz/?a={rng.randint(0, 999)}&b={rng.random()}&c=1" for _ in range(200)]
    rows = [(i, u, "block" if u in bad else "allow") for i, u in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    host, path = url_filter.split_url(F.col("url"))
    labelled = df.where("page_id % 3 > 0").withColumn("host", host).withColumn("path", path)
    model = url_filter.fit(labelled, "url", "page_id")
    held = df.where("page_id % 3 = 0").withColumn("host", host).withColumn("path", path)
    scored = url_filter._featured(held, "url", model.suffixes).withColumn("score", 1 / (1 + F.exp(-url_filter._margin(model.bias, model.trees))))
    right = scored.where("(score >= 0.5) = (verdict = 'block')").count()
    assert right >= 0.97 * scored.count()


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id bigint, url string")
    assert {r.verdict for r in url_filter.judge(df, (), "url", "page_id").collect()} == {"allow"}
    assert {r.verdict for r in url_filter.judge(df, [url_filter.Rule("a.org", "/", "block")], "url", "page_id").collect()} == {"block"}
    assert url_filter.judge(df.limit(0), RULES, "url", "page_id").isEmpty()


def test_url_plan_has_no_python(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    plan = url_filter.judge(df, RULES, "url", "page_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def programmes(spark, n=600):
    """Names of programmes in two kinds, one in ten of the second."""
    rng = random.Random(6)
    rows = [(i, sentence(rng, SPANISH if i % 10 else ENGLISH, rng.randint(3, 30)), "grado" if i % 10 else "pregrado") for i in range(n)]
    return frame(spark, rows, "row_id bigint, nombre_raw string, tipo string")


def test_rates_meet_the_targets(spark):
    df = programmes(spark)
    model = mixing.fit(df, df.where("row_id % 3 = 0"))
    mixed = mixing.mix(df, model, {"grado": 0.5, "pregrado": 0.5})
    total = mixed.agg(F.sum("tokens")).first()[0]
    for k in range(2):
        got = mixed.agg(F.sum(F.col("tokens") * F.col("posterior")[k] * F.col("rate"))).first()[0]
        assert got == pytest.approx(total / 2, rel=0.01)
    copied = mixed.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("copies"))).collect()
    assert all(r[1] == pytest.approx(total / 2, rel=0.2) for r in copied)
    assert mixed.where("rate < 0 or copies not in (floor(rate), floor(rate) + 1)").isEmpty()
    assert mixed.where("abs(posterior[0] + posterior[1] - 1) > 1e-9").isEmpty()


def test_rates_of_widely_shared_rows(spark):
    rng = np.random.default_rng(1)
    share = rng.dirichlet([1, 1, 1], 200)
    tokens = rng.integers(1, 500, 200).astype(float)
    members = spark.createDataFrame([(float(t), s.tolist()) for t, s in zip(tokens, share, strict=True)], "tokens double, posterior array<double>")
    goal = tokens.sum() * np.array([0.5, 0.3, 0.2])
    rows = mixing.fit_rates(members, goal.tolist()).collect()
    found = sum(r.tokens * r.rate * np.array(r.posterior) for r in rows)
    assert min(r.rate for r in rows) >= 0 and np.abs(found - goal).max() < 0.01 * goal.sum()


def test_keeping_all_rows(spark):
    df = programmes(spark)
    model = mixing.fit(df, df)
    mixed = mixing.mix(df, model, {"grado": 0.6, "pregrado": 0.4}, keep_all=True)
    assert mixed.where("copies < 1").isEmpty() and mixed.count() == df.count()
    tokens = {r[0]: r[1] for r in mixed.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("copies"))).collect()}
    assert tokens["pregrado"] / sum(tokens.values()) == pytest.approx(0.4, abs=0.05)


def test_mixing_odd_and_empty_tables(spark):
    df = programmes(spark)
    model = mixing.fit(df, df)
    found = {r.row_id: r for r in mixing.mix(odd_rows(spark).withColumn("rate", F.lit("x")), model, {"grado": 1.0}).collect()}
    assert len(found) == len(ODD_TEXTS) + 1 and all(found[i].tokens == 0 for i in (0, 1, 2))
    assert found[0].posterior == pytest.approx([0.9, 0.1], abs=1e-6) and found[4].rate == found[5].rate
    none = mixing.fit(df.limit(0), df.limit(0))
    assert {(r.rate, r.domain) for r in mixing.mix(df, none, {}).collect()} == {(1.0, None)}
    assert mixing.mix(df.limit(0), model, {"grado": 1.0}).isEmpty()
    with pytest.raises(ValueError):
        mixing.mix(df, model, {"posgrado": 1.0})


def test_repeated_ids_keep_samples_and_blocks_small(spark, monkeypatch):
    rows = [(7, [1.0, 2.0, 3.0])] * 400 + [(0, [1.0, 2.0, 3.5])]
    df = spark.createDataFrame(rows, "id_evaluacion bigint, puntajes array<double>").repartition(4)
    drawn = []

    def fit_tree(unit, leaves, fit=neighbours.fit_tree):
        drawn.append(len(unit))
        return fit(unit, leaves)

    def cell_sizes(batches, k):
        sizes = Counter()
        for batch in batches:
            leaf, row, query, side = (batch.column(i).to_pylist() for i in range(4))
            sizes.update(cell for cell, s in zip(zip(leaf, row, query, strict=True), side, strict=True) if s == 1)
        n = list(sizes.values())
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(n, pa.float64())], ["query_id", "neighbour_id", "score"])

    monkeypatch.setattr(neighbours, "fit_tree", fit_tree)
    monkeypatch.setattr(neighbours, "_meet_task", cell_sizes)
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 8)
    largest = neighbours.search(df, df.where("id_evaluacion = 0")).where("rank = 1").first().score
    assert 20 <= drawn[0] <= 120 and largest <= 40
