"""Token sequences: vector packing, packed rows, flat token files."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.staged import ODD_TEXTS, SPANISH, WORDS, frame, odd_rows, sentence
from starloom.llm import packed_output, token_counts, vector_packing
from starloom.llm.packed_output import CapacityTree


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def texts(n=300, seed=1):
    rng = random.Random(seed)
    marks = [".", ",", "!", "...", "'s", " 3.", "?.", "-", "<|endoftext|>", "É.", "\u0301.", "½,"]
    made = [" ".join(w.title() + rng.choice([*marks, "", "", ""]) for w in sentence(rng, SPANISH, rng.randint(0, 120)).split()) for _ in range(n)]
    return [*ODD_TEXTS, *made, made[0], made[0]]


def rebuilt(pieces):
    out = {}
    for p in sorted(pieces, key=lambda p: (p[0] is not None, p[0] or 0, p[1])):
        ids = out.setdefault(p[0], [])
        assert len(ids) == p[1]
        ids += p[2]
    return out


def test_ids_are_those_of_the_whole_text(spark, encode):
    rows = list(enumerate(texts()))
    found = vector_packing.pack(frame(spark, rows), WORDS).collect()
    got = rebuilt((r.row_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found)
    assert got == {i: encode(t) + [1] for i, t in rows}
    assert all(r.record_tokens == len(got[r.row_id]) and r.length * 4 == len(r.ids) for r in found)


def sequences(found):
    out = {}
    for r in sorted(found, key=lambda r: r.offset):
        rows = out.setdefault(r.sequence_id, [])
        assert r.offset == sum(x.length for x in rows)
        rows.append(r)
    return list(out.values())


def test_sequences_are_full_but_for_the_last(spark):
    found = sequences(vector_packing.pack(frame(spark, list(enumerate(texts()))).coalesce(1), WORDS).collect())
    sizes = [sum(r.length for r in s) for s in found]
    assert max(sizes) <= 2048 and sum(s < 2048 for s in sizes) <= 1


@pytest.mark.parametrize("limits", [vector_packing.Limits(64, 3, 64), vector_packing.Limits(100, 50, 20), vector_packing.Limits(1, 1, 1)])
def test_three_limits_at_once(spark, encode, limits):
    rows = [(i, sentence(random.Random(i), SPANISH, i % 40), "pregunta " * (i % 13)) for i in range(80)]
    df = frame(spark, rows, "row_id bigint, nombre_raw string, apellido_raw string")
    found = vector_packing.pack(df, WORDS, prompt="apellido_raw", limits=limits).collect()
    for s in sequences(found):
        assert sum(r.length for r in s) <= limits.tokens
        assert len(s) <= limits.segments
        assert sum(r.loss_tokens for r in s) <= limits.loss_tokens
    got = rebuilt((r.row_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found)
    assert got == {i: encode(p) + encode(t) + [1] for i, t, p in rows}
    loss = {}
    for r in found:
        loss[r.row_id] = loss.get(r.row_id, 0) + r.loss_tokens
    assert loss == {i: len(got[i]) - max(1, len(encode(p))) for i, _, p in rows}


def test_packing_odd_tables(spark):
    assert vector_packing.pack(odd_rows(spark).limit(0), WORDS).isEmpty()
    found = vector_packing.pack(odd_rows(spark), WORDS).collect()
    assert {r.row_id for r in found} == {None, *range(len(ODD_TEXTS))}
    assert [r.length for r in found if r.row_id == 0] == [1]
    with pytest.raises(ValueError):
        vector_packing.pack(odd_rows(spark), WORDS, limits=vector_packing.Limits(tokens=0))


def test_capacity_tree_finds_the_least_room_that_is_enough():
    rng, tree, held = random.Random(3), CapacityTree(50), []
    for row in range(2000):
        if rng.random() < 0.6:
            room = rng.randint(1, 50)
            tree.put(room, row)
            held.append(room)
        else:
            need = rng.randint(1, 50)
            best = min((h for h in held if h >= need), default=None)
            assert (tree.take(need) is None) == (best is None)
            if best is not None:
                assert tree.found == best
                held.remove(best)


@pytest.mark.parametrize("row_tokens", [16, 2048])
def test_packed_rows_round_trip(spark, encode, tmp_path, row_tokens):
    rows = list(enumerate(texts(120)))
    packed = packed_output.write(packed_output.pack(frame(spark, rows), WORDS, row_tokens=row_tokens), str(tmp_path / "rows")).collect()
    pieces = []
    for r in packed:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == row_tokens and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any() and not positions[r.n_tokens :].any()
        for key, start, a, b in zip(r["keys"], r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces.append((key, start, ids[a:b].tolist()))
    assert rebuilt(pieces) == {i: encode(t) + [49407] for i, t in rows}
    assert len({r.sequence_id for r in packed}) == len(packed)


def test_best_fit_decreasing_pads_little(spark):
    packed = packed_output.pack(frame(spark, list(enumerate(texts(2000, seed=8)))).coalesce(1), WORDS)
    used = packed.agg(F.sum("n_tokens"), F.count("*")).first()
    assert used[0] >= 0.98 * 2048 * used[1]


def test_packed_rows_of_odd_tables(spark):
    assert packed_output.pack(odd_rows(spark).limit(0), WORDS).isEmpty()
    keys = packed_output.pack(odd_rows(spark), WORDS).select(F.explode("keys").alias("k")).distinct().collect()
    assert {r.k for r in keys} == {None, *range(len(ODD_TEXTS))}


def test_counts_of_flattened_rows(spark, encode, tmp_path):
    rows = list(enumerate(texts(200)))
    frame(spark, rows).repartition(5).write.parquet(str(tmp_path / "rows"))
    places = token_counts.flatten(spark.read.parquet(str(tmp_path / "rows")), WORDS, str(tmp_path / "flat"))
    counted = token_counts.count(spark, str(tmp_path / "flat")).withColumn("part", token_counts.part_number())
    found = places.join(counted, ["part", "document"], "left").collect()
    assert {r.row_id: r.n_tokens for r in found} == {i: len(encode(t)) for i, t in rows}
    assert len(found) == len(rows) and all(r.complete for r in found)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_counts_across_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    expected = {}
    for name in range(6):
        ids = [rng.choice([5, 6, 7, 9]) for _ in range(rng.randint(0, 150))]
        np.array(ids, dtype="<u2").tofile(tmp_path / f"f{name}.bin")
        start = 0
        number = 0
        for at, value in enumerate([*ids, None]):
            if value == 9 or (value is None and at > start):
                expected[f"f{name}.bin", number] = (start, at - start, value == 9)
                start, number = at + 1, number + 1
    found = token_counts.count(spark, str(tmp_path), end_id=9, block_tokens=block).collect()
    got = {(r.file.rsplit("/", 1)[1], r.document): (r.first_token, r.n_tokens, r.complete) for r in found}
    assert got == expected and len(found) == len(expected)


def test_no_text_has_the_end_id(encode):
    assert all(token_counts.END_ID not in encode("".join(map(chr, range(a, a + 500)))) for a in (0, 0x400, 0x2000, 0x4E00, 0x1F300))
