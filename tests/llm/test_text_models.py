"""Language identification, quality classifier and fertility rules."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.staged import ENGLISH, ODD_TEXTS, PIECES, SPANISH, frame, odd_rows, sentence
from starloom.llm import fertility, language, mixing, quality_model
from starloom.llm.columns import drawn_texts
from starloom.llm.words import slices, words_of

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def languages(spark, n=400):
    rng = random.Random(1)
    rows = [(i, sentence(rng, SPANISH if i % 2 else ENGLISH, rng.randint(4, 30)), "es" if i % 2 else "en") for i in range(n)]
    return frame(spark, rows, "row_id bigint, nombre_raw string, idioma string")


def test_words_are_split_at_ascii_white_space_only():
    texts = ["a  b", None, "", " \n", "x\u00a0y\tz\x0b\x0cw", "\u2003q"]
    found = words_of(pa.array([t or "" for t in texts], pa.large_string()))
    expected = [SPLIT.findall(t or "") for t in texts]
    assert found.counts.tolist() == [len(e) for e in expected]
    assert [found.distinct[c].as_py() for c in found.codes.tolist()] == [w for e in expected for w in e]


def test_slices_keep_every_text():
    values = pa.array(["a" * n if n % 7 else None for n in range(50)])
    parts = list(slices(values.slice(3), 40))
    assert [t for p in parts for t in p.to_pylist()] == [t or "" for t in values.slice(3).to_pylist()]


def test_language_on_held_out_rows(spark):
    rows = languages(spark)
    model = language.fit(rows.where("row_id % 3 <> 1"), label="idioma")
    found = language.predict(rows, model).where("row_id % 3 = 1")
    assert found.where("lang_pred = idioma").count() >= 0.97 * found.count()
    assert found.where("score < 0 or score > 1").isEmpty()


def test_language_of_odd_rows_and_clashing_columns(spark):
    model = language.fit(languages(spark), label="idioma")
    rows = odd_rows(spark).withColumn("score", F.lit("alt")).withColumn("lang_pred", F.lit(7)).withColumn("_made", F.lit(1))
    found = language.predict(rows, model)
    assert found.columns == ["row_id", "nombre_raw", "_made", "lang_pred", "score"]
    got = {r.row_id: (r.lang_pred, r.score) for r in found.collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 6))
    assert got[4] == got[5] and got[None][0] in {"en", "es"}


def test_language_score_does_not_depend_on_neighbours(spark):
    rows = languages(spark, 60)
    model = language.fit(rows, label="idioma")
    together = {r.row_id: r.score for r in language.predict(rows.coalesce(1), model).collect()}
    apart = {r.row_id: r.score for r in language.predict(rows.repartition(20), model).collect()}
    assert together == apart


def test_language_of_empty_tables(spark):
    empty = languages(spark).limit(0)
    model = language.fit(empty, label="idioma")
    assert model.labels == []
    assert {r.lang_pred for r in language.predict(odd_rows(spark), model).collect()} == {"und"}
    assert language.predict(empty, model).isEmpty()


def test_language_learns_no_label_from_null(spark):
    rows = languages(spark).withColumn("idioma", F.when(F.col("row_id") > 10, F.col("idioma")))
    assert language.fit(rows, label="idioma").labels == ["en", "es"]


def judged(spark, n=600):
    rng = random.Random(2)
    good = lambda: sentence(rng, SPANISH, rng.randint(8, 40))
    bad = [lambda: good().upper().replace(" ", "!! "), lambda: good().replace(" ", " | "), lambda: (good().split()[0] + " ") * 12]
    rows = [(i, good(), 1) if i % 4 else (i, rng.choice(bad)(), 0) for i in range(n)]
    return frame(spark, rows, "row_id bigint, nombre_raw string, valido int")


def test_quality_on_held_out_rows(spark):
    rows = judged(spark)
    model = quality_model.fit(rows, rows.where("row_id % 5 <> 0"))
    found = quality_model.predict(rows, model).where("row_id % 5 = 0")
    assert found.where("predicted = valido").count() >= 0.97 * found.count()
    good, bad = (found.where(f"valido = {v}").agg(F.avg("score")).first()[0] for v in (1, 0))
    assert good > 0.9 and bad < 0.2


def test_quality_is_repeatable(spark):
    rows = judged(spark, 200)
    first = quality_model.fit(rows.repartition(3), rows)
    second = quality_model.fit(rows.repartition(7), rows)
    assert first.bias == pytest.approx(second.bias, abs=1e-9)
    assert abs(first.weights - second.weights).max() < 1e-6


def test_quality_of_odd_rows_and_empty_tables(spark):
    rows = judged(spark, 200)
    model = quality_model.fit(rows, rows)
    found = {r.row_id: r for r in quality_model.predict(odd_rows(spark).withColumn("predicted", F.lit("x")), model).collect()}
    assert len(found) == len(ODD_TEXTS) + 1 and all(0 <= r.score <= 1 for r in found.values())
    assert found[0].score == found[1].score == found[2].score == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert found[4].score == found[5].score
    none = quality_model.fit(rows.limit(0), rows.limit(0))
    assert {r.score for r in quality_model.predict(odd_rows(spark), none).collect()} == {0.5}
    assert quality_model.predict(rows.limit(0), model).isEmpty()


def plain_measures(text):
    words = SPLIT.findall(text or "")
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_fertility_against_a_plain_version(spark):
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(4)
    texts = [*ODD_TEXTS, "a b\na b\n\na b\n \n", "x y z x y z", "a a a a", "uno # dos $ |\nuno # dos $ |"]
    texts += [sentence(rng, SPANISH[:6], rng.randint(1, 80)).replace("el", "\n") for _ in range(60)]
    found = {r.row_id: r for r in fertility.measure(frame(spark, list(enumerate(texts))), PIECES).collect()}
    model = SentencePieceProcessor(model_file=PIECES)
    for i, text in enumerate(texts):
        assert {k: found[i][k] for k in plain_measures(text)} == plain_measures(text), text
        ids = [x for w in SPLIT.findall(text or "") for x in model.encode(w)]
        assert found[i].n_tokens == len(ids)
        if ids:
            share = [n / len(ids) for n in Counter(ids).values()]
            assert found[i].token_entropy == pytest.approx(-sum(p * math.log2(p) for p in share), abs=1e-9)
            assert found[i].byte_share == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
            assert found[i].chars_per_token == pytest.approx(found[i].word_chars / len(ids))


def test_fertility_verdicts_and_scripts(spark):
    rng = random.Random(5)
    # Words vary as in prose; the few of the sample vocabulary would count as poor.
    rich = [a + b for a in SPANISH for b in ("", "s", "mente", "ción")]
    texts = {
        1: sentence(rng, rich, 120), 2: "a " * 100, 3: None, 4: "corto", 5: "жизнь и судьба человека " * 4,
        6: " ".join(chr(0x12000 + i) for i in range(80)), 7: "123 456",
    }
    found = {r.row_id: r for r in fertility.judge(fertility.measure(frame(spark, list(texts.items())), PIECES)).collect()}
    assert found[1].kept and not found[1].base_failed and found[1].script == "latin"
    assert all(found[i].base_failed and not found[i].kept for i in (2, 3, 4))
    assert found[5].script == "cyrillic" and found[3].script == "none" and found[7].script == "none"
    assert not found[6].base_failed and not found[6].kept and found[6].byte_share > 0.5


def test_fertility_of_an_empty_table_and_clashing_columns(spark):
    rows = frame(spark, [(1, "a", "b")], "row_id bigint, nombre_raw string, script string")
    assert fertility.judge(fertility.measure(rows.limit(0), PIECES)).isEmpty()
    assert fertility.measure(rows, PIECES).first().script == "latin"


def test_evidence_of_letters_at_random(spark):
    """The posterior of noise is as high as any; its evidence is not."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, SPANISH if i % 2 else ENGLISH, 30), "es" if i % 2 else "en") for i in range(200)]
    noise = ["".join(rng.choice("bcdfghjkqvwxzñ ") for _ in range(200)), "Привет мир это русский текст", "漢字 日本語"]
    model = language.fit(frame(spark, rows, "row_id bigint, nombre_raw string, l string"), "nombre_raw", "l", "row_id")
    judged = language.predict(frame(spark, [(i, t) for i, (_, t, _) in enumerate(rows)] + [(900 + i, t) for i, t in enumerate(noise)] + [(990, "")]), model, evidence=True)
    found = {r.row_id: r for r in judged.collect()}
    assert min(found[i].evidence for i in range(200)) > 3
    assert max(found[900 + i].evidence for i in range(3)) < 1.5 and found[990].evidence == 0
    assert max(found[900 + i].score for i in range(3)) > 0.9


def test_labels_that_depend_on_a_phrase(spark):
    """Good and bad texts hold the same words; only which word follows which differs."""
    rng = random.Random(8)

    def text(good):
        words = [rng.choice(SPANISH[:9]) for _ in range(30)]
        at = sorted(rng.sample(range(30), 2))
        words[at[1] : at[1]] = ["actas", "finales"] if good else ["actas", "parciales"]
        words[at[0] : at[0]] = ["notas", "parciales"] if good else ["notas", "finales"]
        return " ".join(words)

    rows = [(i, text(i % 2)) for i in range(1_200)]
    model = quality_model.fit(frame(spark, rows), frame(spark, [(i, i % 2) for i in range(1_000)], "row_id bigint, valido int"))
    judged = quality_model.predict(frame(spark, rows[1_000:]), model, threshold=0.5).collect()
    assert sum(r.predicted == r.row_id % 2 for r in judged) >= 0.95 * len(judged)


def test_an_id_with_very_many_rows_counts_once(spark):
    """Labels and texts of one id join once, not every row with every row."""
    rng = random.Random(2)
    rows = [(i, sentence(rng, SPANISH if i % 2 else ENGLISH, 12)) for i in range(40)] + [(7, sentence(rng, SPANISH, 12)) for _ in range(300)]
    labels = frame(spark, [(i, "es" if i % 2 else "en") for i, _ in rows], "row_id bigint, l string")
    drawn, counts = drawn_texts(frame(spark, rows), labels, "row_id", "l", "nombre_raw", 50)
    assert counts == {"es": 20, "en": 20}
    assert drawn.count() == 40 and drawn.groupBy("row_id").count().where("count > 1").isEmpty()


def plain_language(learned, texts):
    """Naive Bayes over the model's n-gram buckets, with dictionaries."""
    counts, rows = defaultdict(Counter), Counter()
    for text, label in learned:
        buckets, _ = language.grams(pa.array([text], pa.large_string()))
        counts[label].update(buckets.ravel().tolist())
        rows[label] += 1
    labels = sorted(counts)
    size = 1 << language.BITS
    out = []
    for text in texts:
        found = language.grams(pa.array([text], pa.large_string()))[0].ravel().tolist()
        logs = []
        for label in labels:
            total = sum(counts[label].values()) + language.SMOOTHING * size
            logs.append(math.log(rows[label] / len(learned)) + sum(math.log((counts[label][b] + language.SMOOTHING) / total) for b in found))
        best = max(logs)
        out.append((labels[logs.index(best)], 1 / sum(math.exp(x - best) for x in logs)))
    return out


def test_language_against_plain_counts(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    learned = [(t, l) for i, t, l in rows if l is not None and t and len(t) < 1_500][:60]
    texts = [t[:300] for _, t, _ in rows if t and any(c.isalpha() for c in t[:300])][:40]
    model = language.fit(frame(spark, [(i, t, l) for i, (t, l) in enumerate(learned)], "row_id bigint, nombre_raw string, l string"), "nombre_raw", "l", "row_id")
    judged = {r.row_id: r for r in language.predict(frame(spark, list(enumerate(texts))), model).collect()}
    for i, (label, score) in enumerate(plain_language(learned, texts)):
        assert judged[i].lang_pred == label and abs(judged[i].score - score) < 1e-3


def plain_quality(model, text):
    """The score of one text as a sum over its n-grams, one by one."""
    buckets, counts = quality_model.features(pa.array([text], pa.large_string()))
    margin = model.bias + sum(float(model.weights[b]) for b in buckets.ravel().tolist()) * quality_model.SCALE / max(1, int(counts[0]))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def test_quality_scores_against_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    model = quality_model.fit(docs, labels, "text", "quality", "doc_id")
    for r in quality_model.predict(docs, model, "text").where("doc_id % 10 = 3 or text is null").collect():
        assert abs(r.score - plain_quality(model, r.text or "")) < 1e-5


def plain_rates(weigh, belongs, targets, pull, steps):
    """The same projected steps by numpy, over all rates at once."""
    curve = weigh.T @ belongs
    weight = 1 / np.maximum(np.diag(curve), 1e-9 * np.abs(curve).sum(axis=1).max())
    rate = np.ones(len(weigh))
    step = 1 / (max((curve[k] * np.sqrt(weight[k] * weight)).sum() for k in range(len(curve))) + pull)
    for _ in range(steps):
        missed = weigh.T @ rate - targets
        rate = np.maximum(0, rate * (1 - step * pull) + step * pull - step * (belongs * (weight * missed)).sum(axis=1))
    return rate


def test_rates_against_numpy(spark):
    rng = np.random.default_rng(6)
    tokens = rng.integers(1, 80, 120).astype(float)
    belongs = rng.dirichlet([0.4, 0.6, 0.9], 120)
    members = frame(spark, [(int(i), float(t), [float(x) for x in b]) for i, (t, b) in enumerate(zip(tokens, belongs, strict=True))], "row_id bigint, tokens double, posterior array<double>")
    targets = np.array([0.6, 0.3, 0.1]) * tokens.sum()
    scale = max(targets.sum(), 1.0)
    expected = plain_rates(tokens[:, None] * belongs / scale, belongs, targets / scale, mixing.PULL, 40)
    found = {r.row_id: r.rate for r in mixing.fit_rates(members, targets.tolist(), steps=40).collect()}
    assert max(abs(found[i] - expected[i]) for i in range(120)) < 1e-6
    reached = sum(tokens[i] * found[i] * belongs[i] for i in range(120)) / scale
    assert abs(reached - targets / scale).max() < 0.05


def test_plain_posteriors(spark):
    """Without a bound on the evidence the posteriors are those of naive Bayes, whatever the length."""
    rows = [(0, "curso de final"), (1, "the final course " * 100), (2, ""), (3, None)]
    model = mixing.fit(frame(spark, [(i, sentence(random.Random(i), SPANISH if i % 2 else ENGLISH, 9)) for i in range(60)]), frame(spark, [(i, "es" if i % 2 else "en") for i in range(60)], "row_id bigint, tipo string"))
    hashed = {w: b for w, b in spark.sql(f"select w, cast(pmod(xxhash64(w), {mixing.BUCKETS}) as int) b from (select explode(split('curso de final the course', ' ')) w)").collect()}
    for r in mixing.posteriors(frame(spark, rows), model, evidence_words=None, also=["nombre_raw"]).collect():
        logs = [model.prior[k] + sum(model.weights[k][hashed[w]] for w in (r.nombre_raw or "").split()) for k in range(2)]
        assert abs(r.posterior[0] - 1 / (1 + math.exp(min(700, logs[1] - logs[0])))) < 1e-6
    clash = frame(spark, [(1, "curso", 5)], "row_id bigint, nombre_raw string, tokens int")
    assert mixing.mix(clash, model, {"es": 1.0}, also=["tokens"]).first().tokens == 1
