"""Operators without SQL against plain loops: likeness, positions, log ratios, gradients of the fits, crc32 of ids."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from roadspark.llm import ngram_ratio, pairwise_quality, pu_toxicity, token_blocks, winnowing
from roadspark.llm.common import Hasher
from roadspark.llm.wordstats import WordStats

WORDS = ["alpha", "Beta", "gamma,", "delta", "rho", "línea", "ñ", "42", "buy", "now!"]


# ------------------------------------------------------------------ winnowing
def chosen(text):
    """{hash} and [(hash, position)] by the definition: the rightmost least hash of every window."""
    points = winnowing.code_points(text)
    if not len(points):
        return []
    width, hasher = min(winnowing.GRAM, len(points)), Hasher()
    h = [int(hasher.of(hasher.prefix(points[i : i + width]), np.array([0]), np.array([width]))[0]) >> 32 for i in range(len(points) - width + 1)]
    picks = set()
    for i in range(max(1, len(h) - winnowing.WINDOW + 1)):
        part = h[i : i + winnowing.WINDOW]
        picks.add(i + max(k for k, v in enumerate(part) if v == min(part)))
    return [(h[i], i) for i in sorted(picks)]


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = make(60)
    return [make(40), shared + make(10), make(5) + shared, "", None, "x", "aaaa" * 50, "aaaa" * 50, shared, shared[:300] + make(30), "ñandú🙂 " * 40]


def test_likeness_of_edited_and_next_texts(spark, texts):
    got = {r.doc_id: r for r in winnowing.edit_likeness(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    plain, digests = [t or "" for t in texts], {}
    for k, mine in enumerate(plain):
        after, half = plain[(k + 1) % len(plain)], len(mine) // 2
        edited = mine[: len(mine) - half] + after[:half]
        assert got[k].near_next == pytest.approx(jaccard(chosen(mine), chosen(after)))
        assert got[k].near_edited == pytest.approx(jaccard(chosen(mine), chosen(edited)))
        for text, digest in ((mine, got[k].fingerprint), (edited, got[k].edited_fingerprint)):
            assert digests.setdefault(text, digest) == digest
    assert len(set(digests.values())) == len(digests)


def test_positions_point_at_their_grams(spark, texts):
    got = {r.doc_id: r for r in winnowing.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        assert list(zip(got[k].hashes, got[k].positions)) == chosen(text or "")


# ------------------------------------------------------------------ log ratio
def buckets_of(text, n):
    """Buckets of a text's words and word pairs, one gram at a time."""
    def at(gram):
        raw = np.frombuffer(gram.encode(), np.uint8)
        return ngram_ratio.gram_buckets(WordStats().words(raw, np.array([0, len(raw)])), n)[0].tolist()

    words = text.split(" ")
    return [at(w)[0] for w in words] + [at(f"{a} {b}")[2] for a, b in zip(words, words[1:])]


def test_log_ratio_and_verdict(spark):
    rng = random.Random(12)
    docs = [" ".join(rng.choice(WORDS[:6] if k % 2 else WORDS[3:]) + str(rng.randrange(9)) for _ in range(rng.choice([49, 50, 70]))) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    n, trusted = 64, range(1, 12, 2)
    table = ngram_ratio.log_ratios(ngram_ratio.count_grams(df, n), ngram_ratio.count_grams(df.filter("doc_id % 2 = 1 AND doc_id < 12"), n), n)
    grams = [buckets_of(t, n) for t in docs]
    corpus, good = Counter(b for g in grams for b in g), Counter(b for k in trusted for b in grams[k])
    whole, mine = sum(corpus.values()) + n, sum(good.values())
    p = {b: (1 + corpus[b]) / whole for b in range(n)}
    ratio = {b: math.log((good[b] + n * p[b]) / (mine + n) / p[b]) for b in range(n)}
    for r in ngram_ratio.score_documents(df, table, threshold=-0.05).collect():
        g, words = grams[r.doc_id], docs[r.doc_id].split(" ")
        want = sum(ratio[b] for b in g) / len(g)
        assert r.log_ratio == pytest.approx(want, abs=1e-9)
        assert r.kept == (len(words) >= 50 and not r.base_failed and want >= -0.05)


# ------------------------------------------------------------------ the fits
def slopes(loss, w, h=1e-4):
    out = []
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = h
        out.append((loss(w + step) - loss(w - step)) / (2 * h))
    return np.array(out)


def test_pair_gradient(monkeypatch):
    """The gradient of the mean logistic loss of all drawn pairs, pair by pair."""
    rng = np.random.default_rng(3)
    x, good, seen = rng.normal(size=(12, 5)).astype(np.float32), np.arange(12) % 3 > 0, []
    monkeypatch.setattr(pairwise_quality, "PAIRS", 80)
    monkeypatch.setattr(pairwise_quality, "adam", lambda gradient, start, steps, rate: seen.append(gradient) or start)
    pairwise_quality.fit_pairs(x, good, decay=0.01, seed=9)
    draw = np.random.default_rng(9)
    i, j = draw.choice(np.flatnonzero(good), 80), draw.choice(np.flatnonzero(~good), 80)

    def loss(w):
        return sum(math.log1p(math.exp(-float((x[a] - x[b]) @ w))) for a, b in zip(i, j)) / 80 + 0.005 * float(w @ w)

    for w in (np.zeros(5), rng.normal(size=5)):
        assert seen[0](w) == pytest.approx(slopes(loss, w), abs=1e-4)


def test_non_negative_risk_gradient(monkeypatch):
    """Down the risk where its negative part is not negative, else up that part; both cases occur."""
    rng, seen = np.random.default_rng(4), []
    positive = np.arange(60) < 20
    rows = [sorted({1, 3, 7}) if p and rng.random() < 0.9 else sorted(set(rng.choice([1, 11, 13], 2))) for p in positive]
    at, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    monkeypatch.setattr(pu_toxicity, "LEAST_STRENGTH", 0.5)
    monkeypatch.setattr(pu_toxicity, "adam", lambda gradient, start, steps, rate: seen.append((gradient, len(start))) or start)
    prior, decay = 0.3, 0.01
    pu_toxicity.fit_pu(at, first, positive, prior, decay=decay)
    gradient, width = seen[0]
    # the kept buckets, by the rule
    n_pos, n_other = 20, 40
    def strength(b):  # noqa: E306
        a, o = sum(b in r for r, p in zip(rows, positive) if p), sum(b in r for r, p in zip(rows, positive) if not p)
        return abs(a / n_pos - o / n_other) / (math.sqrt((a + o + 1) / 60) / math.sqrt(20)) if a >= pu_toxicity.LEAST_SEEN else 0
    kept = sorted(b for b in set(at.tolist()) if strength(b) >= 0.5)
    assert width == len(kept) + 1 > 2

    def parts(w):
        soft = lambda z: math.log1p(math.exp(-abs(z))) + max(z, 0)
        z = [sum(w[k] for k, b in enumerate(kept) if b in r) + w[-1] for r in rows]
        of = lambda f, mine: sum(f(v) for v, p in zip(z, positive) if p == mine) / (n_pos if mine else n_other)
        return prior * of(lambda v: soft(-v), True), of(soft, False) - prior * of(soft, True)

    signs = set()
    for scale in (0.0, 0.5, 4.0):
        for _ in range(6):
            w = rng.normal(size=width) * scale
            below = parts(w)[1] < 0
            signs.add(below)
            want = slopes((lambda v: -parts(v)[1]) if below else (lambda v: sum(parts(v))), w) + decay * np.append(w[:-1], 0)
            assert gradient(w) == pytest.approx(want, abs=1e-5)
    w = np.array([6.0] * (width - 1) + [-2.0])
    signs.add(parts(w)[1] < 0)
    assert gradient(w) == pytest.approx(slopes((lambda v: -parts(v)[1]) if parts(w)[1] < 0 else (lambda v: sum(parts(v))), w) + decay * np.append(w[:-1], 0), abs=1e-5)
    assert signs == {True, False}


# ------------------------------------------------------------------ token files
def test_query_rows_of_token_files(spark, sf):
    """Start, length and crc32 of every document of the smallest table, by the plain tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: (r[0], r[1] or ""))
    got, at = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_blocks.op8_token_blocks(spark, sf).collect()}, 0
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[doc_id, at] == (len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
