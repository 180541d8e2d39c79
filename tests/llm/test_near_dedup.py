"""Near-duplicate groups against brute force over all pairs."""

import random

import pytest

from roadspark.llm import components, near_dedup


def shingles(text):
    import re

    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    ids = sorted({i for i, _ in rows})
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, n=60):
    """Families of edited copies: similarities all around the limit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows = [(0, ""), (1, None), (2, " \n\t "), (3, "One Two"), (4, "one two"), (5, "one two three")]
    bases = [[word() for _ in range(rng.randint(30, 120))] for _ in range(4)]
    for i in range(6, n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    """Also with tiny blocks, where large keys are split and tied together again."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus(block)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    text = "a b c d e f g"
    rows = [(None, text), (1, text), (1, text), (2, text), (2, "another text of seven words right here")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    assert {r.component_id for r in got if r.doc_id == 1} == {1}


def test_sketch_estimates(spark):
    import numpy as np

    a, b = near_dedup.sample_tables()
    rng = np.random.default_rng(1)
    for share in (0.6, 0.8, 0.95):
        errors = []
        for _ in range(20):
            common = rng.integers(0, 1 << 62, int(1000 * share), np.uint64)
            x, y = (np.concatenate([common, rng.integers(0, 1 << 62, (1000 - len(common)) // 2, np.uint64)]) for _ in "ab")
            p, q = (np.frombuffer(near_dedup.odd_sketch(near_dedup.minhashes(s, a, b)), np.uint64) for s in (x, y))
            true = len(common) / (len(x) + len(y) - len(common))
            errors.append(near_dedup.estimates(np.array([int(np.bitwise_count(p ^ q).sum())]))[0] - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_recall_near_the_limit():
    """Pairs at 0.75 to 0.80: none misses all bands, none falls under the sketch cut."""
    import numpy as np

    a, b = near_dedup.sample_tables()
    rng = np.random.default_rng(3)
    lost = n = 0
    while n < 1500:
        size = int(rng.integers(20, 400))
        common = rng.integers(0, 1 << 62, size, np.uint64)
        own = int(size * rng.uniform(0.25, 1 / 3))  # size / (size + own) lies in 0.75..0.8
        cut = int(rng.integers(0, own + 1))
        x, y = (np.concatenate([common, rng.integers(0, 1 << 62, k, np.uint64)]) for k in (cut, own - cut))
        if 100 * size < 75 * (size + own):
            continue
        n += 1
        p, q = near_dedup.minhashes(x, a, b), near_dedup.minhashes(y, a, b)
        banded = (p.reshape(-1, near_dedup.ROWS) == q.reshape(-1, near_dedup.ROWS)).all(axis=1).any()
        f, g = (np.frombuffer(near_dedup.odd_sketch(s), np.uint64) for s in (p, q))
        lost += not banded or near_dedup.estimates(np.array([int(np.bitwise_count(f ^ g).sum())]))[0] < near_dedup.SURE_BELOW
    assert lost == 0


def test_prefixes_share_a_shingle():
    """Two sets at the limit share one of the larger one's prefix and the smaller one's index prefix, in any fixed order,
    and the first shared one stands early enough in both."""
    rng = random.Random(4)
    met = 0
    for _ in range(5000):
        both, more = rng.randint(1, 60), rng.randint(0, 20)
        cut = rng.randint(0, more)
        order = list(range(both + more))
        rng.shuffle(order)
        x = [k for k in order if k < both + cut]
        y = [k for k in order if k < both or k >= both + cut]
        if len(x) > len(y):
            x, y = y, x
        if 100 * both >= 75 * (both + more):
            met += 1
            first = next(k for k in x if k in set(y))
            assert x.index(first) < near_dedup.index_length(len(x)) and y.index(first) < near_dedup.prefix_length(len(y))
            assert 175 * min(len(x) - x.index(first), len(y) - y.index(first)) >= 75 * (len(x) + len(y))
    assert met > 500


def test_thousands_of_near_templates(spark):
    """Texts that share a template at similarity 0.67 stay apart, and copies among them are found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    template = [word() for _ in range(84)]
    rows = [(i, " ".join(template + [word() for _ in range(20)])) for i in range(5000)]
    copies = {10_000 + k: 17 * k for k in range(100)}
    rows += [(i, rows[of][1] + " end") for i, of in copies.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: copies.get(i, i) for i, _ in rows}


def test_very_long_text(spark):
    """A text of two million characters, and its copy with a changed end."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(280_000))
    df = spark.createDataFrame([(3, text), (2, text[:-9] + "x"), (1, "short")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 2}
