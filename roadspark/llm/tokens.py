"""Token ids of whole batches of texts: the tokenizers library behind a cache of chunks.

Texts are cut where the tokenizer's own rules never join anything: at spaces and newlines,
between letters and digits, between either and common ASCII punctuation, and before
each digit. Letters are those of ASCII and the Latin ones up to U+017F; cutting before
them or another ASCII character is safe for the tokenizer's normal form too.
Each chunk is encoded once by the library and its ids are reused; chunks are found by
64-bit hashes of their lower-case bytes, a batch at a time, so a known word costs a few
array steps and no Python object.
"""

from __future__ import annotations

import os
import sys

import numpy as np
from pyspark import cloudpickle

from roadspark.llm import common as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Slots of the cache, and ids kept in it before it starts anew.
SLOTS, MOST_IDS = 1 << 20, 1 << 23

#: New words that the library gets as one text; its time for a word grows with the text's length.
WORDS = 256

_GAP, _LETTER, _DIGIT, _MARK, _OTHER, _WIDE = range(6)

#: Latin letters have these first bytes in UTF-8, but for two signs and a letter whose small form is two characters.
LATIN, NOT_LATIN = (0xC3, 0xC4, 0xC5), (0xC397, 0xC3B7, 0xC4B0)

#: Fixed value: punctuation that never belongs to a contraction, a special token or a composed character.
MARKS = b"!\"#$%&()*+,-./:;?@[\\]^_{}~"


def byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[128:] = _WIDE
    table[list(b" \n")] = _GAP
    table[list(MARKS)] = _MARK
    table[48:58] = _DIGIT
    table[65:91] = table[97:123] = _LETTER
    return table


def cut_table() -> np.ndarray:
    """Whether a chunk begins at a byte, by 8 * class before + class."""
    table = np.zeros(64, bool)
    for before in range(6):
        for now in (_LETTER, _DIGIT, _MARK, _OTHER, _WIDE):
            table[8 * before + now] = (
                before == _GAP or now == _DIGIT or before == _DIGIT and now != _WIDE or before == _LETTER and now == _MARK or before == _MARK and now == _LETTER
            )
    return table


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Chunks as one text, a space behind each."""
    sizes = ends - starts + 1
    upto = np.cumsum(sizes)
    text = data.take(np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1]), mode="clip")
    text[upto - 1] = 32
    return text.tobytes().decode("utf-8")


def worker_tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of this Python worker, with the chunks that its earlier tasks have met.

    This module travels by value, so its own globals last for one task; those of the library last as long as the worker.
    """
    import tokenizers

    held, file = vars(tokenizers).setdefault("_roadspark_held", {}), (path, os.stat(path).st_mtime_ns)
    if file not in held:
        held.clear()
        held[file] = CachedTokenizer(path)
    return held[file]


class CachedTokenizer:
    """``encode`` gives the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives for each text.

    For word-level BPE tokenizers with word ends, whose ids are below 2**16.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for simple chunks: of the rules before it, only those for small letters and bytes change them
        self.words = Tokenizer(self.tokenizer.model)
        self.words.normalizer = normalizers.Lowercase()
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.classes, self.cuts, self.lower, self.hasher = byte_classes(), cut_table(), C.lower_table(), C.Hasher()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.begin, self.count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def _store(self, ids: list[np.ndarray] | np.ndarray) -> None:
        ids = np.concatenate(ids) if isinstance(ids, list) else ids
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint16)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _encode_chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin in the pool, count) of new chunks; simple ones are one word each for the tokenizer."""
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
        rest = np.flatnonzero(~simple).tolist()
        at = np.flatnonzero(simple)
        for i in range(0, len(at), 4096):
            part = at[i : i + 4096]
            ids: list = []
            for k in range(0, len(part), WORDS):
                ids += self.words.encode_batch_fast([_spaced(data, starts[part[k : k + WORDS]], ends[part[k : k + WORDS]])], add_special_tokens=False)[0].ids
            ids = np.array(ids, np.int64)
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(part):
                rest += part.tolist()
                continue
            begin[part] = self.used + np.append(0, stops[:-1])
            count[part] = np.diff(stops, prepend=0)
            self._store(ids)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            chunks = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[part].tolist(), ends[part].tolist())]
            ids = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            count[part] = [len(x) for x in ids]
            begin[part] = self.used + np.cumsum(count[part]) - count[part]
            self._store(ids)
        return begin, count

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        begin, count, first = self._chunks(data, offsets)
        return C.per_text(count, first)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text) of texts given as bytes and offsets."""
        begin, count, first = self._chunks(data, offsets)
        upto = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        ids = self.pool[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[first]

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin in the pool, count) of every chunk, and the first chunk of each text."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        kinds = self.classes[data]
        lead = np.flatnonzero((data >= LATIN[0]) & (data <= LATIN[-1]))
        if len(lead):
            lead = lead[~np.isin(data[lead].astype(np.int64) * 256 + data[lead + 1], NOT_LATIN)]
            kinds[lead] = kinds[lead + 1] = _LETTER
        before = np.empty_like(kinds)
        before[0], before[1:] = _GAP, kinds[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = _GAP
        starts = np.flatnonzero(self.cuts[8 * before + kinds])
        # a chunk goes on to the next one, a gap, or the end of its text
        stops = np.append((kinds == _GAP) & (before != _GAP), True)
        stops[starts] = True
        stops[offsets] = True
        stops = np.flatnonzero(stops)
        ends = stops[np.searchsorted(stops, starts, "right")]
        first = np.searchsorted(starts, offsets, "left")
        odd = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(kinds >= _OTHER, out=odd[1:])
        simple = odd[ends] == odd[starts]
        hashes = self.hasher.of(self.hasher.prefix(self.lower[data]), starts, ends)
        # a special token is one in its own case only
        angled = np.flatnonzero(data == 60)
        if len(angled):
            at = np.unique(np.searchsorted(starts, angled, "right") - 1)
            hashes[at] = C.mix(self.hasher.of(self.hasher.prefix(data), starts[at], ends[at]) + np.uint64(1))
        hashes |= np.uint64(1)  # 0 marks a free slot
        slot = (hashes >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        other = (hashes >> np.uint64(42)).astype(np.int64) & (SLOTS - 1)
        hit = self.keys[slot] == hashes
        lost = np.flatnonzero(~hit)
        second = self.keys[other[lost]] == hashes[lost]
        slot[lost[second]] = other[lost[second]]
        lost = lost[~second]
        begin, count = self.begin[slot], self.count[slot]
        if len(lost):
            fresh, at, which = np.unique(hashes[lost], return_index=True, return_inverse=True)
            if self.used > MOST_IDS:
                known = np.delete(np.arange(len(hashes)), lost)
                kept, ids = begin[known], self.pool
                self.clear()  # the ids that this batch has found already stay in reach
                self._store(ids[np.repeat(kept - np.cumsum(count[known]) + count[known], count[known]) + np.arange(count[known].sum())])
                begin[known] = np.cumsum(count[known]) - count[known]
            at = lost[at]
            new_begin, new_count = self._encode_chunks(data, starts[at], ends[at], simple[at])
            begin[lost], count[lost] = new_begin[which], new_count[which]
            slot = slot[at]
            taken = self.keys[slot] != 0
            slot = np.where(taken & (self.keys[other[at]] == 0), other[at], slot)
            self.keys[slot], self.begin[slot], self.count[slot] = fresh, new_begin, new_count
            # of several new chunks on one slot the last has it; key, begin and count agree as all are written in one order
        return begin, count, first
