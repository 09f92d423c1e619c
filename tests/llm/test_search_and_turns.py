"""Ranked search, chat formatting and the prefix trie against plain Python, on staged and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.staged import ENGLISH, ODD_TEXTS, SPANISH, frame, sentence, staging
from starloom.llm import chat_format, prefix_trie, ranked_search
from starloom.plans import university as u

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(rows, requests, k=20):
    """Scores of all rows for all requests by the formula."""
    documents = [(key, Counter(TERM.findall((text or "").translate(SMALL)))) for key, text in rows]
    documents = [(key, held) for key, held in documents if held]
    size, total = len(documents), sum(sum(held.values()) for _, held in documents)
    held_by = Counter(t for _, held in documents for t in held)
    asked = defaultdict(list)
    for key, text in dict.fromkeys(requests):
        asked[key] += TERM.findall((text or "").translate(SMALL))
    out = []
    for request, terms in asked.items():
        scores = []
        for key, held in documents:
            damping = 100 - 25 + (25 * sum(held.values()) * size) // total
            score = sum(
                math.floor(1000 * math.log((2 * size + 2) / (2 * held_by[t] + 1))) * ((10**9 * held[t]) // (1000 * held[t] + 12 * damping))
                for t in terms
            )
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        out += [(request, i, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.choice((SPANISH, ENGLISH)), rng.randint(0, 25))) for i in range(size)]
    # Ties: the same text under many ids, repeated rows, one id with several texts, and no id.
    return rows + [(1_000 + i, "curso de examen") for i in range(40)] + [(7, "curso final")] * 3 + [(None, "curso final"), (None, "y")]


@pytest.mark.parametrize(("terms", "postings"), [(200_000, 4_000_000), (9, 60)])
def test_search_in_blocks_of_any_size(spark, terms, postings):
    rows = corpus(3, 300) + [(9_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    requests = [(i, sentence(random.Random(i), SPANISH + ENGLISH, 6)) for i in range(12)]
    requests += [(3, "curso curso FINAL"), (3, "curso curso FINAL"), (50, None), (51, "¿?! #"), (52, "nunca visto"), (None, "examen 123"), (53, "漢字 x")]
    got = ranked_search.search(frame(spark, rows), frame(spark, requests), most_terms=terms, most_postings=postings)
    assert found(got) == plain_search(rows, requests)


def test_search_stops_before_the_end_of_its_lists():
    """The bound of best positions ends the reading early, and nothing better was left unread."""
    rng = np.random.default_rng(5)
    documents, terms = 20_000, 3
    document = np.tile(np.arange(documents), terms)
    term = np.repeat(np.arange(terms), documents)
    impact = rng.pareto(1.0, documents * terms).astype(np.int64) + 1
    impact[:documents][:50] += 10_000
    index = ranked_search.ImpactLists(document, term, impact, documents, terms)
    reads = []
    index.ranked = type("Counting", (np.ndarray,), {"__getitem__": lambda self, i: reads.append(i) or np.ndarray.__getitem__(self, i)})(
        shape=index.ranked.shape, dtype=index.ranked.dtype, buffer=index.ranked.copy()
    )
    scores, best = index.best(np.arange(terms), np.ones(terms, dtype=np.int64), 20)
    total = impact.reshape(terms, -1).sum(axis=0)
    order = np.lexsort((np.arange(documents), -total))[:20]
    assert best.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert max(i.stop - i.start for i in reads) < documents / 4


def test_search_of_courses_for_programmes(spark):
    courses, programmes = staging(spark, "curso"), staging(spark, "programa")
    rows = [(r.row_id, r.nombre_raw) for r in courses.collect()]
    requests = [(r.row_id, f"{r.nombre_raw} álgebra 2") for r in programmes.collect()]
    asked = programmes.withColumn("nombre_raw", F.concat("nombre_raw", F.lit(" álgebra 2"))).withColumn("key", F.lit(0)).withColumn("terms", F.lit(""))
    assert found(ranked_search.search(courses, asked)) == plain_search(rows, requests)


def test_search_of_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "curso"), (2, None)])
    for rows, requests in ((none, some), (some, none), (none, none), (frame(spark, [(1, None), (2, "?")]), some)):
        got = ranked_search.search(rows, requests)
        assert got.columns == ["request", "rank", "row_id", "score"] and got.count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string"
MARKS = ["</s>", "[INST]", "[/INST]", "[NEXT]", "\\", "[\\INST]", "\\\\[INST]", "[", "<", "[INST", "/INST]", "[[INST]]", "</s></s>", "\n", ""]


def turn_rows():
    rng = random.Random(11)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            text = "".join(rng.choice([*MARKS, "sí ", "𝔘", "ok"]) for _ in range(rng.randint(0, 6)))
            rows.append((c, t, rng.choice(["user", "user", "assistant", "[/INST]", ""]), text))
    rows += [(100, i % 700, "assistant", f"largo {i} </s>") for i in range(1_500)]  # one long block, ties
    rows += [(101, None, None, None), (101, 1, None, "a"), (101, 1, "user", "a"), (101, 1, "user", "a"), (None, 1, "user", "x"), (102, 0, "user", None)]
    return rows + [(200 + i, 0, "assistant", t) for i, t in enumerate(ODD_TEXTS)]


def in_order(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        held[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in held.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_formatted_turns_are_read_back(spark):
    rows = turn_rows()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumns({"turns": F.lit(1), "t": F.lit(2), "formatted": F.lit(3)})
    formatted = chat_format.format_turns(df, "conv_id", "turn", "role", "text", chat_format.CHAT)
    expected = in_order(rows)
    kept = {r.conv_id: r for r in formatted.collect()}
    assert set(kept) == set(expected)
    for c, turns in expected.items():
        blocks = [t for i, t in enumerate(turns) if i == 0 or turns[i - 1][0] != t[0]]
        assert (kept[c].n_turns, kept[c].n_blocks) == (len(turns), len(blocks))
        assert kept[c].formatted.count("</s>") == kept[c].formatted.count("[/INST]") == len(blocks)
        cut = [kept[c].formatted[s.start : s.start + s.length] for s in kept[c].loss_spans]
        assert [re.sub(r"\\(.)", r"\1", x, flags=re.S) for x in cut] == [text for role, text in turns if role == "assistant"]
    for r in chat_format.digest(formatted, "conv_id", chat_format.CHAT).collect():
        turns = expected[r.conv_id]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(kept[r.conv_id].formatted))


def test_templates_with_marks_that_overlap_are_refused():
    for marks in ({"start": "aa"}, {"end": "[NEXT]"}, {"end": "T]x"}, {"start": "x\\y"}, {"end": "["}, {"following": "[INST]s"}):
        with pytest.raises(ValueError):
            chat_format.Template(**marks)


def exams(spark):
    return u.ENTITIES["examenes"].clean(staging(spark, "examen"))


def test_attempts_as_turns(spark):
    rows = exams(spark).collect()
    expected = in_order([(r.id_inscripcion, r.numero_intento, r.resultado, str(r.nota)) for r in rows])
    read = chat_format.read_turns(chat_format.format_turns(exams(spark)))
    assert {r.id_inscripcion: [tuple(t) for t in r.turns] for r in read.collect()} == expected
    learned = {r.id_inscripcion: r.learned for r in read.collect()}
    assert all(learned[c] == [x for role, x in turns if role == "Aprobado"] for c, turns in expected.items())


def test_empty_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat_format.digest(chat_format.format_turns(none, "conv_id", "turn", "role", "text"), "conv_id").count() == 0
    trie = prefix_trie.build(prefix_trie.coded(none, "conv_id", "turn", "role", "text"))
    assert trie.nodes.count() == 0 and prefix_trie.ends_digests(trie).count() == 0


def plain_trie(sequences):
    """Every node by its prefix: the fields of the operator and the digest of its ends."""
    members, words = defaultdict(list), defaultdict(int)
    for key, turns in sorted(sequences.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(key)
            words[tuple(turns[:d])] = len(re.findall(r"[^\x20\x09-\x0D]+", turns[d - 1][1])) if d else 0
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, held in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(held) - 1) * words[p]
    out = []
    for p, held in members.items():
        ends = sha(",".join(str(k) for k in held if len(sequences[k]) == len(p)))
        out.append((len(p), held[0], members[p[:-1]][0] if p else None, len(held), children[p], leaves[p], saved[p], ends))
    return sorted(out, key=repr)


def trie_rows(trie):
    nodes = trie.nodes.join(prefix_trie.ends_digests(trie), "node", "left").fillna(sha(""), ["ends_digest"])
    assert nodes.groupBy("node").count().where("count > 1").isEmpty()
    return found(nodes.select("depth", "first_id", "parent_first_id", "members", "children", "leaves", "saved_tokens", "ends_digest"))


def plain_sequences(spark, rows):
    """Sequences in the operator's order: ties of a turn by their code."""
    coded = prefix_trie.coded(spark.createDataFrame(rows, TURNS), "conv_id", "turn", "role", "text")
    codes = {r.code: r for r in coded.collect()}
    assert all(len(c) == 32 for c in codes)
    code_of = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, code_of(role or "", text or ""), (role or "", text or "")))
    return {c: [t[3] for t in sorted(turns)] for c, turns in held.items()}


@pytest.mark.parametrize(("sequences", "turns"), [(100_000, 500_000), (3, 500_000), (50, 12), (1, 1)])
def test_trie_in_blocks_of_any_size(spark, sequences, turns):
    rng = random.Random(5)
    rows = [r for r in turn_rows() if r[0] != 100]
    for c in range(300, 420):  # shared beginnings, equal sequences, sequences that begin others
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user", "hola" if t == 0 or c % 3 else rng.choice(["uno dos", "tres", ""])))
    rows += [(500, i, "user", "paso") for i in range(60)] + [(501, i, "user", "paso") for i in range(59)]
    expected = plain_sequences(spark, rows)
    coded = prefix_trie.coded(spark.createDataFrame(rows, TURNS), "conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(600,), (601,), (300,), (None,)], "id bigint")
    trie = prefix_trie.build(coded, more, most_sequences=sequences, most_turns=turns)
    assert trie_rows(trie) == plain_trie(expected | {600: [], 601: []})


def test_trie_of_attempts(spark):
    rows = [(r.id_inscripcion, r.numero_intento, r.resultado, str(r.nota)) for r in exams(spark).collect()]
    noisy = exams(spark).withColumns({"key": F.lit(0), "code": F.lit(""), "words": F.lit(1)})
    trie = prefix_trie.build(prefix_trie.coded(noisy))
    assert trie_rows(trie) == plain_trie(plain_sequences(spark, rows))
    assert set(trie.nodes.columns) >= {"node", "parent", "depth", "members"}


def test_trie_of_sequences_without_turns(spark):
    none = prefix_trie.coded(spark.createDataFrame([], TURNS), "conv_id", "turn", "role", "text")
    trie = prefix_trie.build(none, spark.createDataFrame([(5,), (3,)], "id bigint"))
    assert trie_rows(trie) == plain_trie({5: [], 3: []})


def test_range_minima():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 5, 200)
    table = prefix_trie.SparseTable(values)
    at, depth = np.repeat(np.arange(200), 6), np.tile(np.arange(6), 200)
    left, right = table.left_extent(at, depth), table.right_extent(at, depth)
    for i, d, a, b in zip(at, depth, left, right, strict=True):
        assert (values[a + 1 : b + 1] >= d).all()
        assert a == 0 or values[a] < d
        assert b == 199 or values[b + 1] < d
    assert (table.least(left, right) == [values[a : b + 1].min() for a, b in zip(left, right, strict=True)]).all()
