"""The stages of the pipeline on planted rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
from llm.staged import ENGLISH, ODD_TEXTS, SPANISH, WORDS, sentence
from llm.test_groups import runs
from tokenizers import Tokenizer

from starloom.llm import language, quality_model
from starloom.llm.queries import remainder

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WIDE = [a + b for a in ENGLISH for b in ("", "s", "ly", "ing", "ed", "er")]


def documents(spark, rows):
    """Documents of (doc_id, text) rows."""
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCUMENTS)


def changed(text, places):
    words = text.split()
    for place in places:
        words[place] = f"changed{place}"
    return " ".join(words)


def similarity(a, b):
    return len(runs(a) & runs(b)) / len(runs(a) | runs(b))


def test_near_duplicates_from_four_fifths_on(spark):
    rng = random.Random(4)
    rows, kept = [], set()
    for group in range(60):
        base = sentence(rng, WIDE, 150)
        near, far = changed(base, (20, 70, 120)), changed(base, (20, 50, 80, 110))
        assert 0.80 <= similarity(base, near) < 0.85 and similarity(base, far) < 0.80
        rows += [(2 * group, base), (2 * group + 1, near if group % 2 else far)]
        kept |= {2 * group} if group % 2 else {2 * group, 2 * group + 1}
    found = corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(kept)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c, d = (sentence(rng, WIDE, 150) for _ in range(4))
    near_a, near_b = changed(a, (20, 70)), changed(b, (30,))
    rows = [(5, a)] * 7 + [(9, near_a)] * 3  # a batch that came again
    rows += [(20, near_b), (30, b), (30, c), (40, changed(c, (60,)))]  # two texts of 30, each in a group of its own
    rows += [(50, d), (50, changed(d, (80,)))] + [(60, None)] * 2 + [(None, a)] * 2
    found = corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows).repartition(5), "")
    got = [(r.doc_id, r.text) for r in found.collect()]
    fifty = next(t for i, t in got if i == 50)
    assert fifty in (d, changed(d, (80,)))
    expected = [(5, a), (20, near_b), (30, c), (50, fifty), (60, None), (None, a), (None, a)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_mixing_of_repeated_ids(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, sentence(rng, WIDE, 60), "en") for i in range(80)] + [(100 + i, sentence(rng, SPANISH, 30), "es") for i in range(10)]
    rows += [rows[-1]] * 6 + [(None, rows[-2][1], "es")] * 2
    docs = spark.createDataFrame([(i, t, lang, "web", len(t)) for i, t, lang in rows], DOCUMENTS)
    docs.where("doc_id is not null").select("doc_id").distinct().write.parquet(str(tmp_path / "labels.parquet"))
    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect())
    given = Counter((i, t) for i, t, _ in rows)
    assert mixed.keys() == given.keys()
    # Alike documents differ by one copy at most, repeated rows and rows without an id included.
    copies = {k: mixed[k] / given[k] for k in given}
    spanish = [copies[(i, t)] for i, t, lang in rows if lang == "es"]
    assert all(c == int(c) for c in copies.values()) and max(spanish) - min(spanish) <= 1 and min(spanish) > 1


def odd_documents(spark):
    """Clean documents in four languages between nulls, empty and blank texts, noise, repeated and nameless rows."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in given.collect()]
    odd = [(9_000 + i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)]
    noise = [(9_500, "zxqj wkvb pfgh xqzz jjkw vbnm " * 9, None, "web", 1), (9_501, "Привет мир это русский текст", None, "web", 1)]
    again = [docs[0]] * 4 + [(None, *docs[1][1:])] * 2
    return spark.createDataFrame(docs + odd + noise + again, given.schema), docs


def write_labels(spark, docs, folder):
    given = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    given.write.parquet(f"{folder}/labels.parquet")
    return {r.doc_id: r.quality for r in given.collect()}


def test_language_stage_against_plain_rules(spark, tmp_path):
    """What goes: texts without a letter, and those that are no likelier in any language than by chance."""
    rows, docs = odd_documents(spark)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.language_stage(spark, rows, str(tmp_path)).collect())
    clean = Counter((i, t) for i, t, *_ in docs if t and len(re.findall(r"[^\W\d_]", t)) >= 20)
    assert not clean - kept
    assert kept[(docs[0][0], docs[0][1])] == 5 and kept[(None, docs[1][1])] == 2
    assert not [1 for i, t in kept if i in (9_500, 9_501) or not any(c.isalpha() for c in t or "")]
    learned = rows.where(remainder("doc_id", 3) != 1)
    model = language.fit(learned, "text", "lang", "doc_id")
    for (i, t), n in Counter((r.doc_id, r.text) for r in rows.collect()).items():
        found = language.grams(pa.array([t or ""], pa.large_string()))[0].ravel()
        if len(found):
            totals = [float(model.table[found, k].astype(float).sum()) for k in range(len(model.labels))]
            best = max(range(len(totals)), key=lambda k: totals[k] + model.prior[k])
            evidence = totals[best] / len(found) + language.BITS * math.log(2)
            if abs(evidence - corpus_pipeline.LEAST_LANGUAGE_EVIDENCE) > 1e-3 and len(t) > 40:
                assert kept[(i, t)] == (n if evidence > corpus_pipeline.LEAST_LANGUAGE_EVIDENCE else 0)


def test_quality_stage_against_plain_scores(spark, tmp_path):
    rows, docs = odd_documents(spark)
    labels = write_labels(spark, docs, tmp_path)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, rows, str(tmp_path)).collect())
    learned = spark.createDataFrame([(i, q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5], "doc_id bigint, quality int")
    model = quality_model.fit(rows, learned, "text", "quality", "doc_id")
    for (i, t), n in Counter((r.doc_id, r.text) for r in rows.collect()).items():
        buckets, counts = quality_model.features(pa.array([t or ""], pa.large_string()))
        margin = model.bias + float(model.weights[buckets].sum()) * quality_model.SCALE / max(1, int(counts[0]))
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))
        if abs(score - quality_model.THRESHOLD) > 1e-4:
            assert kept[(i, t)] == (n if score > quality_model.THRESHOLD else 0)


def test_packing_stage_of_odd_documents(spark, tmp_path):
    """Every id of every row lies in one piece, in sequences without gaps or overlaps."""
    rows, _ = odd_documents(spark)
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    expected = Counter()
    for r in rows.collect():
        expected[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    held, places = Counter(), defaultdict(list)
    for p in corpus_pipeline.packing_stage(spark, rows, str(tmp_path)).collect():
        held[p.doc_id] += p.length
        places[p.sequence_id].append((p.offset, p.length))
    assert held == expected
    for pieces in places.values():
        ends = [0]
        for offset, length in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def test_stages_of_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCUMENTS)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
