"""The other training-data operators: brute force, round trips, edge cases."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspark.llm import coder, line_blocks, mixing, ngram_ratio, packing, pairwise_quality, pu_toxicity, stages, token_blocks, toolcalls, winnowing
from roadspark.llm.common import Hasher, text_bytes, pieces
from roadspark.llm.wordstats import WordStats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "a", "one two\nthree", "x " * 400, "línea ñandú 🙂 end\n\nlínea ñandú 🙂 end\n| # |", "To To To To To", "same line\nother\nsame line\n \nlast", "  nb sp", "word" * 5000]
DOCS = "doc_id long, text string, source string, score double"


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None if i % 4 == 3 else f"s{i % 3}", 0.5) for i, t in enumerate(texts)], DOCS)


# ------------------------------------------------------------------ winnowing
def plain_winnow(points, gram, window):
    hasher, n = Hasher(), len(points)
    if not n:
        return []
    width = min(gram, n)
    h = [int(hasher.of(hasher.prefix(points), np.array([i]), np.array([i + width]))[0]) >> 32 for i in range(n - width + 1)]
    out = []
    for i in range(max(1, len(h) - window + 1)):
        part = h[i : i + window]
        at = i + max(k for k, v in enumerate(part) if v == min(part))
        if not out or out[-1] != (h[at], at):
            out.append((h[at], at))
    return out


@pytest.mark.parametrize("text", ["", "ab", "abcabcabcabcabcabc", "aaaaaaaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog again and again"])
def test_winnow_equals_definition(text):
    points = winnowing.code_points(text)
    h, p = winnowing.winnow(points, Hasher(), 5, 4)
    assert list(zip(h.tolist(), p.tolist())) == plain_winnow(points, 5, 4)


def test_shared_passages_share_a_hash():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    passage = text(winnowing.GRAM + winnowing.WINDOW - 1)
    a, b = (set(winnowing.winnow(winnowing.code_points(text(200) + passage + text(90)), Hasher())[0].tolist()) for _ in "ab")
    assert a & b


def test_edited_texts(spark):
    rows = [(5, "abcdef"), (2, "xyz"), (9, None), (9, "repeat"), (None, "last of all"), (7, "ñandú🙂")]
    got = winnowing.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert winnowing.edit_likeness(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ------------------------------------------------------------------ tool calls
def test_tool_calls(spark):
    calls = [
        (1, "c", "search", '{"query":"x","limit":3}', ["a", "b"]), (1, "a", "search", '{"limit": 2.0, "query": "é\\n"}', []), (1, "b", "search", '{"limit":0,"extra":1}', ["a"]),
        (1, "d", "nope", "not json", ["z", None]), (1, "e", "search", None, ["f"]), (1, "f", "translate", '{"query":"q","to":"xx"}', ["e"]), (1, None, "search", "{}", None),
        (1, "a", "search", '{"limit": 2.0, "query": "é\\n"}', []),
    ]
    results = [("a", '{"b":1,"a":[1.0]}'), ("a", '{"z":1}'), ("q", "1")]
    got = {r.call_id: r for r in toolcalls.link_tool_calls(
        spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, depends_on array<string>"), spark.createDataFrame(results, "call_id string, payload string"), toolcalls.SCHEMAS).collect()}
    assert {k: r.depth for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, None: 0}
    assert got["a"].record == '{"arguments":{"limit":2,"query":"é\\n"},"call_id":"a","depends_on":[],"name":"search","result":{"a":[1],"b":1}}'
    assert got["a"].valid and got["b"].errors == "$.query: required; $.extra: additional; $.limit: minimum"
    assert got["d"].errors == "$: json" and got["d"].n_dangling == 1 and json.loads(got["d"].record)["arguments"] == "not json"
    assert got["f"].errors == "$.to: enum" and got["c"].has_result is False


# ---------------------------------------------------------------- base counts
def test_base_counts():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(TEXTS, pa.string()))
    got = {}
    for i, j in pieces(offsets, 50):
        for k, v in WordStats().counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1].items():
            got.setdefault(k, []).extend(v.tolist())
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + d for k, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)}
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t[:30]


def test_ratio_keeps_and_drops(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rng.randrange(40)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rng.choice(["buy", "win", "free"]) + str(rng.randrange(40)) for _ in range(80)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + ["", "short"])] + [(None, None)], "doc_id long, text string")
    trusted = df.filter("doc_id < 30")
    table = ngram_ratio.log_ratios(ngram_ratio.count_grams(df, 512), ngram_ratio.count_grams(trusted, 512), 512)
    got = {r.doc_id: r for r in ngram_ratio.score_documents(df, table).collect()}
    assert all(got[i].kept for i in range(60) if not got[i].base_failed) and not any(got[i].kept for i in range(60, 103 - 1))
    assert got[None].base_failed and got[None].log_ratio == 0


# --------------------------------------------------------------------- mixing
def test_mixing_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), s) for s, n in ((None, 40), ("a", 5), ("b", 300), ("c", 90), ("d", 60)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)] + [(0, None, "a")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total, size = sum(r.size for r in got), {}
    for r in got:
        size[r.doc.source] = size.get(r.doc.source, 0) + r.size
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    target, capped = {}, set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = {s: left * w / sum(weight[x] for x in weight if x not in capped) for s, w in weight.items() if s not in capped}
        over = {s for s, v in share.items() if v > 3 * size[s]}
        if not over:
            target = {**share, **{s: 3 * size[s] for s in capped}}
            break
        capped |= over
    for s in weight:
        mine = [r for r in got if r.doc.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6 and all(r.copies <= 3 for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - target[s]) <= 7
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


# ---------------------------------------------------------------- classifiers
def test_held_out_accuracy(spark, sf):
    """On the small tables: ranking of unseen documents."""
    def auc(rows, label):
        pos, neg = [r.score for r in rows if r[label] == 1], [r.score for r in rows if r[label] == 0]
        return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])

    folder = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for op, label, least in ((pairwise_quality.op7_pairwise_quality, "quality", 0.98), (pu_toxicity.op5_pu_toxicity, "toxic", 0.93)):
        rows = op(spark, folder).filter("held_out").join(labels, "doc_id").collect()
        assert all(0 <= r.score <= 1 for r in rows) and auc(rows, label) > least


def test_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark)
    q = pairwise_quality.score_texts(df, *pairwise_quality.train(df, labels), keep=df.columns, out="x").collect()
    p = pu_toxicity.score_texts(df, *pu_toxicity.train(df, labels)).collect()
    assert len(q) == len(p) == len(TEXTS) and {r.score for r in q} == {0.5}
    assert q[0].x == q[1].x
    none = spark.createDataFrame([], DOCS)
    assert pairwise_quality.score_texts(none, *pairwise_quality.train(none, labels)).collect() == []
    assert pu_toxicity.score_texts(none, *pu_toxicity.train(none, labels)).collect() == []


def test_pu_risk_finds_the_word():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(10, 500, 20), [3] if k < 50 or k % 10 == 0 else [])) for k in range(600)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    w, bias = pu_toxicity.fit_pu(np.concatenate(rows).astype(np.int64), first, np.arange(600) < 50, 0.1)
    assert w[3] > 1 and w[3] + bias > 0 > bias


# ----------------------------------------------------------------- token files
@pytest.mark.parametrize("seed", [0, 1])
def test_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 2, 500)] + [np.full(3000, 7), rng.integers(0, 5, 2000), np.array([65535, 0, 65535])]
    packed = token_blocks.pack_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, token_blocks.unpack_blocks(packed)))
    assert len(packed[4]) < 200
    broken = bytearray(packed[3])
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        token_blocks.unpack_blocks([bytes(broken)])
    assert coder.encode_blocks([]) == []


def test_a_coded_block_costs_its_entropy_and_its_statistics():
    rng = np.random.default_rng(3)
    words = rng.choice(49408, 400, replace=False)
    blocks = [words[np.minimum(rng.geometric(0.012, 2048) - 1, 399)] for _ in range(5)] + [rng.permutation(49408)[:2048], np.arange(3000) * 20, np.array([9])]
    packed = token_blocks.pack_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, token_blocks.unpack_blocks(packed)))
    for block, raw in zip(blocks, packed):
        counts = np.unique(block, return_counts=True)[1]
        ids = (counts * np.log2(len(block) / counts)).sum() / 8
        assert len(raw) < min(1.02 * ids + 9 * len(counts) / 8 + len(block) / 8 + 60, 2 * len(block) + 20)
    assert token_blocks.unpack_blocks(packed[3:4])[0].tolist() == blocks[3].tolist()  # any block alone


def test_every_block_is_coded():
    """Blocks whose own statistics do not pay are coded with equal shares, none is stored as it is."""
    rng = np.random.default_rng(5)
    blocks = [rng.permutation(49408)[:n] for n in (1, 2, 3, 40, 2048, 5000)] + [rng.integers(0, high, n) for high in (1, 2, 3, 49408, 65535, 65536) for n in (1, 2, 7, 900)]
    blocks += [np.full(3000, 7), np.zeros(1), np.array([65535]), np.array([65535, 65535, 0]), np.arange(65536)]
    packed = coder.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, coder.decode_blocks(packed, [len(b) for b in blocks])))
    assert {p[:1] for p in packed} == {coder.CODED, coder.EQUAL}
    for block, payload in zip(blocks, packed):
        assert len(payload) <= 7 + 2 * np.ceil(len(block) * np.log2(block.max() + 1) / 16) and len(payload) <= 3 + 2 * len(block)
    assert len(packed[4]) < 2 * len(blocks[4])  # distinct ids: once longer than the ids as they are


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(3, "Hello, World! it's 2024"), (1, None), (2, ""), (2, "a\nb"), (None, "the end"), (8, "many words here " * 3000)]
    token_blocks.write_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, f"{tmp_path}/t")
    got = token_blocks.read_documents(spark, f"{tmp_path}/t").collect()
    starts = {r.range: r.begins for r in token_blocks.range_starts(spark, f"{tmp_path}/t").collect()}
    got = sorted(((starts[r.range] + r.first + r.before, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=lambda r: r[0])
    order, at = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), 0
    for (start, doc_id, ids), (i, t) in zip(got, order):
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (start, doc_id, ids) == (at, i, want)
        at += len(want)
    assert len(got) == len(rows)


# --------------------------------------------------------------------- packing
def test_best_fit(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, None, 1, 5, 255, 256, 257, 700, 2048, 2049, 9000])) for i in range(300)] + [(7, 300), (7, 300), (None, 12)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, size long")).collect()
    assert sum(r.length for r in got) == sum(s or 0 for _, s in sizes)
    bins = {}
    for r in got:
        assert (r.bin_id is None) == (r.length == 0)
        if r.length:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.length))
    used = 0
    for (_, capacity), parts in bins.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        full = sum(n for _, n in parts)
        assert capacity == min(c for c in packing.LENGTHS if c >= full)
        used += capacity
    assert sum(s or 0 for _, s in sizes) / used > 0.97
    assert packing.pack(spark.createDataFrame([], "doc_id long, size long")).collect() == []


# ------------------------------------------------------------------- main text
PAGE = """<html><head><title>T</title><script>var a = "</p>";</script></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies</div>{open}<h1>Head &amp; line</h1><p>First   para<br>goes on.<p class=x>Second <b>para</b>.<div class="ad">Buy</div><p><a href=y>Only a link</a></p>
<p>Third &lt;one&gt;.{close}<section id="comments"><p>Nice article, thank you very much for it.</p></section><form>Sign up</form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
def test_main_text(wrap):
    page = PAGE.format(open=wrap[0], close=wrap[1])
    assert line_blocks.main_text(page) == "Head & line\nFirst para goes on.\nSecond para.\nOnly a link\nThird <one>."


def test_broken_pages(spark):
    pages = ["", None, "no markup at all", "<p", "<div>unclosed <b>text", "<!-- open", "<a href='x>y", "<script>only", "&amp;&am", "<p>" * 3000 + "deep"]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in line_blocks.extract(df, ["page_id", "url"]).collect()}
    assert got[0] == got[1] == "" and got[2] == "no markup at all" and got[4] == "unclosed text" and got[9] == "deep" and len(got) == len(pages)


# -------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("rep", F.lit(1))
    before, packed = docs, None
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        if name == "best-fit packing":
            packed = after
            break
        assert after.columns == docs.columns
        path = f"{stages.materialize(after, 'test').inputFiles()[0].rpartition('/')[0]}"
        after = spark.read.parquet(path)
        assert after.filter("score <> 'mine'").isEmpty()
        if name != "mixing sources":
            assert after.select("doc_id").exceptAll(before.select("doc_id")).isEmpty() and after.count() < before.count()
        before = after
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before.select("doc_id", "text").toLocalIterator())
    got = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    each = Counter()
    for (doc_id, n), times in want.items():
        each[doc_id] += n * times
    assert {r.doc_id: r.n for r in got} == dict(each)
