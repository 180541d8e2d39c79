"""Counts of words, symbols, lines and repeated windows for every text of a piece."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

from roadspark.llm import common as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: the symbol characters that are counted.
SYMBOLS = b"#*$%&|<>"


@dataclass
class Words:
    """Words of a piece: byte spans, hashes, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


class WordStats:
    """Keeps the byte tables and hash powers of one task."""

    def __init__(self) -> None:
        self.hasher = C.Hasher()
        self.word = C.word_table()
        self.symbol = C.member_table(SYMBOLS)

    def words(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None, sums: np.ndarray | None = None) -> Words:
        inside = self.word[data] if inside is None else inside
        starts, ends, first = C.spans(inside, offsets)
        sums = self.hasher.prefix(data) if sums is None else sums
        return Words(starts, ends, first, self.hasher.of(sums, starts, ends))

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, dict[str, np.ndarray]]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text.

        Lines are split at newlines; only lines with a word count, and they count as
        duplicates when equal, byte for byte, to an earlier line of the text.
        Repeat words are the words in three-word windows that stand twice or more.
        """
        inside = self.word[data]
        sums = self.hasher.prefix(data)
        words = self.words(data, offsets, inside, sums)
        starts, ends, first = C.spans(data != 10, offsets)
        filled = np.zeros(len(data) + 1, np.int64)
        np.cumsum(inside, out=filled[1:])
        full = filled[ends] > filled[starts]
        row = C.owners(first)[full]
        keys = self.hasher.of(sums, starts[full], ends[full])
        line_first = np.searchsorted(row, np.arange(len(offsets)))
        dup = C.repeats(C.within(keys, line_first))[1]
        window, at = C.windows(words.first, len(words.hashes), 3)
        shared = C.repeats(C.within(C.combine(words.hashes, window, 3), at))[0]
        covered = np.zeros(len(words.hashes), bool)
        for k in range(3):
            covered[window[shared] + k] = True
        return words, {
            "n_words": np.diff(words.first),
            "word_chars": C.per_text(inside & ((data & 0xC0) != 0x80), offsets),
            "n_symbols": C.per_text(self.symbol[data], offsets),
            "n_dup_lines": C.per_text(dup, line_first),
            "n_repeat_words": C.per_text(covered, words.first),
        }
