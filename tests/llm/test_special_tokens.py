"""Markers in texts get the ids that the plain tokenizer gives them."""

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from roadspark.llm import common
from roadspark.llm.tokens import CachedTokenizer


def ids_of(tokenizer, texts):
    ids, at = tokenizer.encode(*common.text_bytes(pa.array(texts)))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_markers_encode_as_in_the_plain_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(6)
    bits = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", " ", "  ", "\n", "Hello", "it's", "42", "é", ","]
    texts = ["<|startoftext|>a b<|endoftext|>\n<|endoftext|> end"] + ["".join(rng.choices(bits, k=12)) for _ in range(500)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0].count(49406) == 1 and want[0].count(49407) == 2
    assert ids_of(CachedTokenizer(path), texts) == want


def test_any_text_encodes_as_in_the_plain_tokenizer(monkeypatch):
    """Also where the cache overflows and starts anew, and where chunks share slots."""
    from roadspark.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(7)
    alphabet = list("abcXYZ019 .,;:!?()'\"-<|>\n\t `=~_&#$%") + ["'s", "'ll", "<|endoftext|>", "é", "Ü", "×", "ŉ", "\u0301", "\u0338", "ß", "Σ", "²", "½", "…", "\u00a0", "日", "🙂", "İ", "ǅ", "´", "٣"]
    for slots, most in ((1 << 20, 1 << 23), (64, 40)):
        monkeypatch.setattr(tokens, "SLOTS", slots)
        monkeypatch.setattr(tokens, "MOST_IDS", most)
        mine = CachedTokenizer(path)
        for _ in range(40):
            texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(50)]
            want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
            assert ids_of(mine, texts) == want
            assert mine.counts(*common.text_bytes(pa.array(texts))).tolist() == [len(w) for w in want]
