"""Quality rules from tokenizer fertility: how well a public vocabulary fits a text.

Runs on staged texts of the project (``nombre_raw``). For each text: characters
per token, share of tokens that are single fallback bytes, and entropy of its
token ids in bits; rejection bands for the three are held per script.

Null and empty texts have no word: counts and measures are 0, the script is
``none`` and the row is not kept. Repeated texts get equal results. Other columns
are kept; columns that have the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.columns import by_slices, ship, struct_array, with_struct
from starloom.llm.token_ids import piece_tokenizer
from starloom.llm.words import Words, combined, group_sums, slices, words_of

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

# First code point and name of each stretch of the code space that holds one script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


@dataclass(frozen=True)
class Band:
    """What a text of one script may measure to be kept."""

    least_chars_per_token: float
    most_chars_per_token: float
    most_byte_share: float
    least_entropy: float


DEFAULT_BAND = Band(0.5, 16.0, 0.50, 3.0)
BANDS: Mapping[str, Band] = {
    "latin": Band(1.5, 12.0, 0.10, 4.5),
    "greek": Band(0.8, 8.0, 0.10, 3.5),
    "cyrillic": Band(1.0, 10.0, 0.10, 4.0),
    "han": Band(0.3, 4.0, 0.90, 4.0),
    "kana": Band(0.3, 4.0, 0.60, 3.5),
    "hangul": Band(0.3, 4.0, 0.90, 3.5),
}

FIELDS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "script": "string", "n_tokens": "bigint", "chars_per_token": "double", "byte_share": "double", "token_entropy": "double",
}


def _repeat_words(words: Words) -> np.ndarray:
    """Words that lie in a run of three words which occurs twice or more in their text."""
    texts = np.repeat(np.arange(len(words.counts), dtype=np.uint64), words.counts)
    runs = combined(words.codes.astype(np.uint64), 3)
    inside = texts[2:] == texts[: len(runs)]
    starts = np.flatnonzero(inside)
    keys = combined(np.stack((texts[starts], runs[starts]), axis=1).ravel(), 2)[::2]
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    covered = np.zeros(len(words.codes), dtype=np.int64)
    for step in range(3):
        covered[starts[twice] + step] = 1
    return group_sums(covered, words.counts)


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of their text."""
    parts = pc.split_pattern(texts, "\n")
    lines, counts = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(pc.ascii_trim(lines, " \t\v\f\r")), 0).to_numpy(zero_copy_only=False)
    coded = lines.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique((owner * max(1, len(coded.dictionary)) + codes)[filled])
    different = np.bincount(pairs // max(1, len(coded.dictionary)), minlength=len(counts))
    return group_sums(filled.astype(np.int64), counts) - different


def _scripts(words: Words) -> np.ndarray:
    """The script most of a text's words begin with (ties: the first of ``NAMES``); ``none`` without letters."""
    letters = pc.utf8_slice_codeunits(pc.replace_substring_regex(words.distinct, r"^\PL+", ""), 0, 1)
    points = np.array([ord(c) if c else -1 for c in letters.to_pylist()], dtype=np.int64)
    place = np.searchsorted([start for start, _ in SCRIPTS], points, side="right") - 1
    own = np.array([NAMES.index(name) for _, name in SCRIPTS] + [-1])[place][words.codes]
    votes = np.stack([group_sums((own == i).astype(np.int64), words.counts) for i in range(len(NAMES))], axis=1)
    return np.array([*NAMES, "none"], dtype=object)[np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), len(NAMES))]


def _entropy(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of entropy of the ids of each text."""
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    keys = np.sort(owner << 32 | ids.astype(np.int64))
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    often = np.diff(np.append(first, len(keys))).astype(np.float64)
    kinds = np.bincount(keys[first] >> 32, minlength=len(counts))
    total = np.maximum(1, counts).astype(np.float64)
    return np.log2(total) - group_sums(often * np.log2(often), kinds.astype(np.int64)) / total


def _measure(texts: pa.Array, vocabulary: str) -> pa.Array:
    words = words_of(texts)
    tokenizer = piece_tokenizer(vocabulary)
    ids, counts = tokenizer.of_words(words)
    per_word = {
        "chars": pc.utf8_length(words.distinct),
        "symbols": pc.count_substring_regex(words.distinct, pattern=r"[#*$%&|<>]"),
    }
    totals = {k: group_sums(v.to_numpy(zero_copy_only=False).astype(np.int64)[words.codes], words.counts) for k, v in per_word.items()}
    tokens = np.maximum(1, counts)
    return struct_array(
        n_words=pa.array(words.counts),
        word_chars=pa.array(totals["chars"]),
        n_symbols=pa.array(totals["symbols"]),
        n_dup_lines=pa.array(_repeated_lines(texts)),
        n_repeat_words=pa.array(_repeat_words(words)),
        script=pa.array(_scripts(words), pa.string()),
        n_tokens=pa.array(counts),
        chars_per_token=pa.array(totals["chars"] / tokens),
        byte_share=pa.array(group_sums(tokenizer.is_byte[ids].astype(np.int64), counts) / tokens),
        token_entropy=pa.array(np.where(counts > 0, _entropy(ids, counts), 0.0)),
    )


def measure(df: DataFrame, vocabulary: str, text: str = "nombre_raw") -> DataFrame:
    """Add word counts and fertility measures of every whole text; ``vocabulary`` is a sentencepiece model file."""
    ship(df.sparkSession)
    fields = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
    return with_struct(df, by_slices(partial(_measure, vocabulary=vocabulary), fields, slices)(F.col(text)), list(FIELDS))


def _within(band: Band) -> Column:
    return (
        F.col("chars_per_token").between(band.least_chars_per_token, band.most_chars_per_token)
        & (F.col("byte_share") <= band.most_byte_share)
        & (F.col("token_entropy") >= band.least_entropy)
    )


def judge(
    measured: DataFrame,
    bands: Mapping[str, Band] = BANDS,
    default: Band = DEFAULT_BAND,
    least_words: int = LEAST_WORDS,
    most_repeated_percent: int = MOST_REPEATED_PERCENT,
) -> DataFrame:
    """Add ``base_failed`` (too few words, or too many in repeated runs) and ``kept`` to measured rows."""
    verdict = reduce(lambda rest, item: F.when(F.col("script") == item[0], _within(item[1])).otherwise(rest), bands.items(), _within(default))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)
