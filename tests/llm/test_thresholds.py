"""Thresholds cover all labelled rows, also those that the fit does not see."""

import random

import numpy as np
import pytest

from roadspark.llm import pairwise_quality, pu_toxicity
from roadspark.llm.common import is_held_out


@pytest.fixture(scope="module")
def tables(spark):
    """400 documents; every tenth is bad and toxic, some in a weaker way, and a tenth of the labels are wrong."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 10 == 0
        words = [rng.choice(["alpha", "beta", "Gamma", "delta,"]) for _ in range(60)]
        for _ in range(rng.randrange(2, 30) if bad else rng.randrange(0, 4)):
            words[rng.randrange(60)] = f"VILE{rng.randrange(10)}!!"
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad == (rng.random() < 0.1)), int(bad)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labels, {r.doc_id: (r.quality, r.toxic) for r in labels.filter(~is_held_out()).collect()}


def test_quality_cut_is_the_quantile_of_all_labelled_rows(monkeypatch, tables):
    docs, labels, known = tables
    monkeypatch.setattr(pairwise_quality, "MOST_ROWS", 60)
    w, cut, scale = pairwise_quality.train(docs, labels)
    looks, rows = pairwise_quality.Looks(), sorted(docs.filter(~is_held_out()).collect())
    s = np.array([looks.rows(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))[0] @ w.astype(np.float32) for r in rows], float)
    good = np.array([known[r.doc_id][0] for r in rows]) == 1
    assert len(rows) > 300 and cut == pytest.approx(np.quantile(s, 1 - good.mean(), method="midpoint"), abs=1e-5)


def test_toxicity_bias_has_the_least_risk_of_all_rows(monkeypatch, tables):
    docs, labels, known = tables
    monkeypatch.setattr(pu_toxicity, "MOST_POSITIVE", 20)
    monkeypatch.setattr(pu_toxicity, "MOST_UNLABELLED", 40)
    monkeypatch.setattr(pu_toxicity, "LEAST_STRENGTH", 0.5)
    w, bias = pu_toxicity.train(docs, labels)
    letters, rows = pu_toxicity.Letters(), sorted(docs.filter(~is_held_out()).collect())
    z = []
    for r in rows:
        data = np.frombuffer(r.text.encode(), np.uint8)
        z.append(w[np.unique(letters.buckets(data, np.array([0, len(data)]))[0])].sum())
    z, pos = np.array(z), np.array([known[r.doc_id][1] for r in rows]) == 1
    prior = pos.mean()

    def risk(at):
        flagged = (z >= at).mean()
        missed = (z[pos] < at).mean()
        return prior * missed + max(0, flagged - prior * (1 - missed))

    assert len(rows) > 300 and w.any()
    values = np.unique(z)
    assert risk(-bias) == pytest.approx(min(map(risk, np.append((values[1:] + values[:-1]) / 2, values[-1] + 1))), abs=1e-9)
    assert bias == pytest.approx(-pu_toxicity.least_risk(z[pos], z, prior), abs=2e-3)
