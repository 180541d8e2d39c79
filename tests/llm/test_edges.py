"""Nulls, repeats, ties, clashing names and hostile inputs of the training-data operators; choices against brute force."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspark.llm import line_blocks, mixing, packing, stages, toolcalls

WIDE = "doc_id long, text string, source string, size long, hash string, copies int, doc string, target double, _stage_score_ double, cut long"


def wide(spark, rows):
    """Documents whose other columns bear the names that the operators use inside."""
    return spark.createDataFrame([(i, t, s, -1, "mine", 7, "d", 0.5, 2.0, 3) for i, t, s in rows], WIDE)


# ----------------------------------------------------------------- tool calls
CALL = "conv_id long, call_id string, name string, arguments string, depends_on array<string>"


def linked(spark, calls, results=(), schemas=None):
    return {r.call_id: r for r in toolcalls.link_tool_calls(
        spark.createDataFrame(calls, CALL), spark.createDataFrame(list(results), "call_id string, payload string"), toolcalls.SCHEMAS if schemas is None else schemas
    ).collect()}


def test_hostile_json(spark):
    deep, long = "[" * 100_000, "9" * 400
    calls = [(1, "deep", "search", deep, []), (1, "long", "search", f'{{"query":"q","limit":{long}}}', []), (1, "huge", "search", '{"query":"q","limit":1e400}', []),
             (1, "nan", "search", '{"query":"q","limit":NaN}', []), (1, "nest", "search", '{"query":' + "[" * 900 + "]" * 900 + ',"limit":2}', [])]
    got = linked(spark, calls, [("long", "-Infinity"), ("nan", deep)])
    assert [got[k].errors for k in ("deep", "huge", "nan")] == ["$: json"] * 3
    assert got["long"].errors == "$.limit: maximum"
    for r in got.values():
        json.loads(r.record, parse_constant=lambda name: pytest.fail(name))
    assert json.loads(got["long"].record)["result"] == "-Infinity"


def test_null_conversations_and_empty_tables(spark):
    turns = [(None, 1, "user", "a"), (None, 1, "user", "b"), (None, 2, "assistant", "c"), (4, None, "user", "d"), (4, 1, "user", "e")]
    calls, results = toolcalls.calls_of_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = toolcalls.link_tool_calls(calls, results, toolcalls.SCHEMAS).collect()
    assert sorted((r.conv_id or 0, r.call_id or "", r.has_result) for r in got) == [(0, "", False), (0, "", False), (4, "", False), (4, "4:1", False)]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.link_tool_calls(*toolcalls.calls_of_conversations(none), toolcalls.SCHEMAS).collect() == []


@pytest.mark.parametrize("most", [100_000, 3])
def test_depths(spark, most):
    """A chain, a diamond, a cycle with a tail, a self link, a lone call; in one task a group, and peeled."""
    n = 1500 if most > 3 else 6
    links = [(f"c{k}", f"c{k + 1}") for k in range(n)] + [("d0", "d1"), ("d0", "d2"), ("d1", "d3"), ("d2", "d3"), ("d0", "d3")]
    links += [("y0", "y1"), ("y1", "y2"), ("y2", "y0"), ("y2", "y3"), ("s", "s")]
    calls = sorted({x for pair in links for x in pair} | {"lone"})
    got = toolcalls.topological_depth(spark.createDataFrame([(x,) for x in calls], "call_id string"), spark.createDataFrame(links + links[:3], "parent string, child string"), most)
    want = {f"c{k}": k for k in range(n + 1)} | {"d0": 0, "d1": 1, "d2": 1, "d3": 2, "lone": 0} | dict.fromkeys(["y0", "y1", "y2", "y3", "s"])
    assert {r.call_id: r.depth for r in got.collect()} == want


# --------------------------------------------------------------------- mixing
def test_null_and_repeated_ids_part_by_their_texts(spark):
    """A source of null ids alone and one of a single repeated id come near their targets."""
    rows = [(None, f"w{k} and two", "a") for k in range(200)] + [(7, f"x{k} and two", "b") for k in range(200)] + [(k, "three more words", "c") for k in range(100, 900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("doc.source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t")).collect()
    assert len(got) == 3 and all(abs(r.n - r.t) <= 3 for r in got)


def test_equal_rows_are_split_like_others(spark, tmp_path, monkeypatch):
    """Of a source of rows equal in id and text as many are taken as come nearest; rows and SQL agree."""
    import duckdb

    monkeypatch.setattr(mixing, "BLOCK", 7)
    rows = [(1, "a " * 40, "a")] * 1000 + [(k, "one two three", "b") for k in range(5000)] + [(9, "x", "c")] * 9 + [(None, None, "c")] * 3 + [(2, "p q r s", None)] * 50
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    frame.coalesce(1).write.parquet(f"{tmp_path}/w")
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got = mixing.op4_mix_sources(spark, str(tmp_path)).collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duckdb.sql(mixing.OP4_SQL.strip()).fetchall()))
    again = mixing.mix_sources(frame.withColumn("s", F.lit(1)).withColumn("_rank", F.lit("mine"))).collect()
    assert sorted((r.size, r.target, r.copies * r.size) for r in again) == sorted((r.size, r.target, r.taken) for r in got)
    for source in {r.doc.source for r in again}:
        mine = [r for r in again if r.doc.source == source]
        most = max(r.size for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= most / 2 + 1e-6 and len({r.copies for r in mine if r.size}) <= 2
    assert len(again) == len(rows) and {r.doc._rank for r in again} == {"mine"}


def test_word_count(spark):
    texts = ["", None, " ", "a", "a b", " a\t\tb\n\nc ", "a\x0bb\x0cc\rd", "é  ü ö", "x" * 9 + "   y", "  ", " a"]
    import re

    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# --------------------------------------------------------------------- stages
@pytest.mark.parametrize("stage", [stages.quality, stages.toxicity, stages.deduplicate, stages.mix, stages.pack])
def test_stages_on_odd_rows(spark, sf, stage):
    """Null ids, null and empty texts, repeated rows, clashing columns, and an empty table pass through every stage."""
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(None, text, "a"), (None, None, None), (1, None, "a"), (2, "", None), (3, text, "a"), (3, text, "a"), (4, text + " end", "b"), (5, "short", "b")]
    docs = wide(spark, rows)
    out = stage(spark, docs, sf)
    kept = out.collect()
    assert stage(spark, docs.filter("false"), sf).collect() == []
    if stage is stages.pack:
        assert {r.doc_id for r in kept} == {None, 1, 2, 3, 4, 5} and sum(r.piece == 0 for r in kept) == len(rows)
        return
    assert out.columns == docs.columns and {r.hash for r in kept} <= {"mine"} and {r.size for r in kept} <= {-1}
    if stage is stages.deduplicate:
        assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(0, text), (0, ""), (1, ""), (2, ""), (3, text), (5, "short")])
    else:
        every = {(i, t, s) for i, t, s in rows}
        assert {(r.doc_id, r.text, r.source) for r in kept} <= every


# -------------------------------------------------------------------- packing
def plain_best_fit(lengths, permitted):
    """The same rules without tables of spaces."""
    bins, still = [], sorted(lengths, reverse=True)
    for n in sorted(lengths, reverse=True):
        still.remove(n)
        room = [(c - sum(b), -k) for k, (c, b) in enumerate(bins) if c - sum(b) >= n]
        if room:
            space = min(room)[0]
            bins[next(k for k, (c, b) in enumerate(bins) if c - sum(b) == space)][1].append(n)
            continue
        best = None
        for c in permitted:
            if c >= n:
                full = n
                for m in still:
                    if m <= c - full:
                        full += m
                price = packing.cost(min(p for p in permitted if p >= full)) / full
                if best is None or price <= best[0]:
                    best = price, c
        bins.append((best[1], [n]))
    return sorted(min(p for p in permitted if p >= sum(b)) for _, b in bins)


def total(capacities):
    return sum(map(packing.cost, capacities))


def packed(lengths, permitted=packing.LENGTHS):
    bins, _, capacity = packing.best_fit(np.array(sorted(lengths, reverse=True)), permitted)
    return [capacity[bins == b][0] for b in range(bins.max() + 1)]


def test_choices_equal_the_plain_rules():
    rng = random.Random(8)
    for _ in range(150):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 25))]
        assert sorted(packed(lengths, (8, 16, 32, 64))) == plain_best_fit(lengths, (8, 16, 32, 64))


def test_near_the_best_of_all_packings():
    rng, permitted = random.Random(9), (256, 512, 1024, 2048)
    worst = 0.0
    for _ in range(60):
        lengths = [rng.randint(1, 2048) for _ in range(rng.randint(1, 6))]
        best = None
        for assigned in itertools.product(range(len(lengths)), repeat=len(lengths)):
            sums = [sum(n for n, b in zip(lengths, assigned) if b == k) for k in set(assigned)]
            if max(sums) <= 2048:
                price = total(min(p for p in permitted if p >= x) for x in sums)
                best = price if best is None else min(best, price)
        worst = max(worst, total(packed(lengths)) / best)
    assert worst < 1.25


def test_several_lengths_cost_less_than_one():
    rng = random.Random(10)
    lengths = [min(2048, int(rng.lognormvariate(5.8, 1.0)) + 1) for _ in range(20_000)]
    mine, alone = packed(lengths), packed(lengths, (2048,))
    assert len(set(mine)) >= 3 and sum(mine) < 1.001 * sum(lengths) and total(mine) < 0.96 * total(alone)


def test_small_sets_waste_little_more_than_they_must():
    """Where the last bins are most of all, against the best of all packings."""

    def partitions(pieces):
        if not pieces:
            yield []
            return
        for rest in partitions(pieces[1:]):
            yield [[pieces[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [pieces[0], *rest[k]], *rest[k + 1 :]]

    rng = random.Random(10)
    mine = least = mine_cost = least_cost = 0
    for _ in range(80):
        lengths = [rng.randint(1, 1500) for _ in range(rng.randint(1, 7))]
        bins = [[next(p for p in packing.LENGTHS if p >= sum(b)) for b in parts] for parts in partitions(lengths) if max(map(sum, parts)) <= 2048]
        got = packed(lengths)
        mine, least = mine + sum(got) - sum(lengths), least + min(map(sum, bins)) - sum(lengths)
        mine_cost, least_cost = mine_cost + total(got), least_cost + min(map(total, bins))
    assert mine <= 1.1 * least and mine_cost <= 1.02 * least_cost


def test_repeated_and_null_ids_share_the_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    rows = [(None, 300)] * 400 + [(5, 200)] * 400 + [(k, 5000) for k in range(50)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, size long")).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.bin_id >> 32, []).append(r.doc_id)
    assert max(map(len, shards.values())) < 200 and sum(r.length for r in got) == 400 * 500 + 50 * 5000


# ------------------------------------------------------------------ main text
def test_window_sums_and_points():
    rng = random.Random(11)
    for _ in range(500):
        m = np.array([rng.choice([0, 0, 0, 1, 40]) for _ in range(rng.randint(1, 30))])
        after, before = line_blocks.window_sums(m, 3)
        assert after.tolist() == [int(m[k : k + 3].sum()) for k in range(len(m))]
        assert before.tolist() == [int(m[max(0, k - 2) : k + 1].sum()) for k in range(len(m))]
        kept = {k for a, b in line_blocks.stretches(m, 3) for k in range(a, b)}
        # from up to two lines before text to up to two lines behind it
        assert kept == {k for k in range(len(m)) if m[max(0, k - 2) : k + 3].sum()}
        strict = {k for a, b in line_blocks.stretches(m, 3, margin=False) for k in range(a, b)}
        full = np.flatnonzero(m).tolist()
        assert strict == set(full) | {k for x, y in zip(full, full[1:]) if y - x <= 3 for k in range(x, y)}


def test_article_keeps_all_its_lines():
    links = "".join(f"<p><a href=x>Other page {k}</a></p>" for k in range(9))
    page = f"<article><h1><a href=y>Title</a></h1><p>First text here.</p><p><a href=z>One link</a></p><p>Second text.</p>{links}<p>Third text.</p></article>"
    want = ["Title", "First text here.", "One link", "Second text.", *(f"Other page {k}" for k in range(9)), "Third text."]
    assert line_blocks.main_text(page).split("\n") == want
    # without an article the same run of links goes, whole
    page = page.replace("article>", "div>").replace("<h1><a href=y>Title</a></h1>", "<h1>Title</h1>")
    assert line_blocks.main_text(page).split("\n") == ["Title", "First text here.", "One link", "Second text.", "Third text."]


@pytest.mark.parametrize("opened", ['<section class="discussion">', '<div class="market-share">', '<section id="related-work">'])
def test_long_text_stays_whatever_its_section_is_called(opened):
    text = [f"<p>{'word ' * 40}{k}.</p>" for k in range(8)]
    close = f"</{opened[1:].split()[0]}>"
    page = f"<article><h1>Title</h1>{''.join(text[:5])}{opened}{''.join(text[5:])}{close}</article>"
    assert len(line_blocks.main_text(page).split("\n")) == 9


def test_adverts_and_comments_go_where_no_article_is_marked():
    text = "".join(f"<p>{'word ' * 60}{k}.</p>" for k in range(4))
    page = f'<body><div class="ad-box">Buy now.</div><div><h1>Title</h1>{text}<p class="comment">Me too</p></div><div class="comments"><p>First!</p><p>{"so true " * 9}</p></div></body>'
    got = line_blocks.main_text(page).split("\n")
    assert got[0] == "Title" and len(got) == 5
    assert line_blocks.main_text('<div><p>Before <span class="ad"><div>Buy</div></span> after</p><p>One <span class="ad">Buy</span> two</p></div>') == "Before\nafter\nOne two"


def test_points_decide_on_pages_without_an_article_mark(sf):
    """Of the fixture's pages, with the mark of the article taken away: on all of them the points leave out the advert, and nothing else."""
    import pyarrow.parquet as pq

    decided = same = pages = 0
    for page in pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist():
        if page:
            bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
            lines = line_blocks.lines_of(bare)
            kept = line_blocks.chosen(lines)
            decided += len(kept) < len(lines)
            same += line_blocks.main_text(bare) == line_blocks.main_text(page)
            pages += 1
    assert decided == same == pages > 0


def test_pages_with_null_ids_repeats_and_a_very_long_one(spark):
    long = "<p>" + "word " * 400_000 + "</p>"
    rows = [(None, "u", "<p>A</p>"), (1, "u", "<p>A</p>"), (1, "u", "<p>A</p>"), (2, None, f"<article>{long}</article>"), (3, "u", None), (4, "u", "")]
    got = line_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1_999_999), (3, 0), (4, 0)]


def test_half_characters_are_broken_json(spark):
    half = '{"query":"\\ud800"}'
    assert toolcalls.read(half, {}) == (half, True)
    assert toolcalls.read('{"query":"\\ud83d\\ude00"}', {}) == ({"query": "\U0001f600"}, False)


def test_least_text_of_an_id_stays(spark):
    rows = [(1, "b " * 9, "s"), (1, "a " * 9, "s"), (1, "a " * 9, "r"), (2, None, "s"), (2, "z", "s"), (None, "q", "s")]
    got = {tuple((r.doc_id, r.text) for r in stages.deduplicate(spark, wide(spark, order), "").orderBy("doc_id").collect()) for order in (rows, rows[::-1])}
    assert got == {((None, "q"), (1, "a " * 9), (2, None))}
