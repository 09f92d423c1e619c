"""Token ids of many texts by public tokenizers, word by word.

The ids of a text are put together from those of its words in order. Words
repeat: a Python worker encodes each word once and numpy does the rest. The
memory of words is bounded: it starts anew, with the words at hand, when new
words would take it beyond ``MOST_WORDS``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from starloom.llm.words import Words, group_sums, ranges, words_of

MOST_WORDS = 600_000
WORDS_PER_CALL = 256

# A full stop or comma after a letter or digit is always a token of its own, so
# it may be cut off beforehand, which leaves far fewer distinct words.
_CUTS = ((". ", " . "), (", ", " , "), (".\n", " .\n"))
_NOT_TO_CUT = r"[^\pL\pN\s][.,]\s"


class WordMemory:
    """Encodes Arrow text columns by the ids of their words."""

    width = np.dtype("<u4")

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=self.width)

    def _encoded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in an order of choice, their ids one after another, and the number of ids of each."""
        raise NotImplementedError

    def _learn(self, words: list[str]) -> None:
        words, ids, lengths = self._encoded(words)
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, ids))

    def _known(self, words: list[str]) -> np.ndarray:
        """The codes of words, -1 for those that are not in the memory."""
        return np.fromiter(map(self.codes.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def of_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        distinct = words.distinct.to_pylist()
        own = self._known(distinct)
        new = np.flatnonzero(own < 0)
        if len(self.codes) + len(new) > MOST_WORDS and self.codes:
            self._clear()
            new = np.arange(len(distinct))
        if len(new):
            unknown = [distinct[i] for i in new.tolist()] if len(new) < len(distinct) else distinct
            self._learn(unknown)
            own[new] = self._known(unknown)
        starts, lengths = self.starts[own][words.codes], self.lengths[own][words.codes]
        return self.flat[ranges(starts, lengths)], group_sums(lengths, words.counts)


def _joined(ids: list[list[int]], width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in ids for i in x], dtype=width), np.array([len(x) for x in ids], dtype=np.int64)


class WordTokenizer(WordMemory):
    """A tokenizer file of the ``tokenizers`` library that lower-cases and never merges across white space.

    Its ids for a whole text are exactly those of the text's words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends_word = np.zeros(size, dtype=bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        super().__init__()

    def _each(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(list(words), add_special_tokens=False)
        return _joined([e.ids for e in found], self.width)

    def _letters(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each`` for words of letters, which are one piece each: encoded together, cut at word ends."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype=self.width)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _encoded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        found = [self._letters(letters[i : i + WORDS_PER_CALL]) for i in range(0, len(letters), WORDS_PER_CALL)]
        found += [self._each(others)] if others else []
        return letters + others, np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has. ``texts`` holds no null."""
        texts = cut = pc.ascii_lower(texts)
        for old, new in _CUTS:
            cut = pc.replace_substring(cut, old, new)
        return self.of_words(words_of(pc.if_else(pc.match_substring_regex(texts, _NOT_TO_CUT), texts, cut)))


class PieceTokenizer(WordMemory):
    """A model file of the ``sentencepiece`` library; each word is encoded on its own."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        super().__init__()

    def _encoded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        return words, *_joined(self.model.encode(words, num_threads=1), self.width)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker and file."""
    return WordTokenizer(path)


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer per Python worker and file."""
    return PieceTokenizer(path)
