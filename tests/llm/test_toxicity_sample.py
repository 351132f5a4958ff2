"""Toxicity against word-by-word versions; long texts are read whole."""

import random
import re

import numpy as np
import pytest

from cartoframe.llm import toxicity as X


def plain_bag(text):
    """{bucket: share}, one n-gram after the other."""
    words, out = re.findall(r"[^\W_]+", (text or "").lower()), {}
    for word in words:
        spelled = f"<{word}>"
        grams = [spelled[i : i + n] for n in range(X.MIN_N, X.MAX_N + 1) for i in range(len(spelled) - n + 1)]
        for g in grams:
            h = ord(g[0])
            for c in g[1:]:
                h = (h * 0x9E3779B1 + ord(c)) % 2**32
            h = (h + len(g)) % 2**32
            h = ((h ^ (h >> 15)) * 0x85EBCA6B) % 2**32
            bucket = (h ^ (h >> 13)) % X.BUCKETS
            out[bucket] = out.get(bucket, 0) + 1 / len(grams) / len(words)
    return out


TEXTS = ["", None, "!!", "a", "Hello, hello wörld_x 12", "日本 日本語のテキスト", "same same same", "long " * 300 + "tail"]


def test_scores_are_those_of_single_ngrams(spark, monkeypatch):
    rng = np.random.default_rng(3)
    model = X.Model(rng.normal(size=X.BUCKETS).astype(np.float32), -0.7)
    want = [1 / (1 + np.exp(-(model.bias + sum(w * float(model.weight[b]) for b, w in plain_bag(t).items())))) for t in TEXTS]
    docs = spark.createDataFrame([(i, t, "old", 1.5) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, Predicted string, score double")
    got = X.score_toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == 2 * len(TEXTS)
    for r in got.collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-5) and r.predicted == int(r.score >= 0.3)
    monkeypatch.setattr(X, "PIECE", 7)
    assert [model.score(t) for t in TEXTS] == pytest.approx(want, rel=1e-5)
    assert X.score_toxicity(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("piece", [20_000, 5])
def test_bags_are_those_of_single_ngrams(monkeypatch, piece):
    monkeypatch.setattr(X, "PIECE", piece)
    cols, weights, bounds, frequency = X._bags([t or "" for t in TEXTS], 1)
    for k, t in enumerate(TEXTS):
        own, want = dict(zip(cols[bounds[k] : bounds[k + 1]].tolist(), weights[bounds[k] : bounds[k + 1]].tolist(), strict=True)), plain_bag(t)
        assert own.keys() == want.keys() and all(own[b] == pytest.approx(want[b], rel=1e-5) for b in want)
    assert frequency.sum() == sum(len(plain_bag(t)) for t in TEXTS)


def test_one_step_is_the_gradient_of_the_loss():
    """Two texts of one n-gram each, one step of each epoch: embeddings and softmax move jointly, as in a loop over numbers."""
    texts, labels = ["b"] * 2 + ["c"] * 2, [1, 1, 0, 0]
    model = X.train(texts, labels, steps=1, rate=0.1, decay=0.0, dropout=0.0, scale=1.0, seed=4)
    rng = np.random.default_rng(4)
    used = sorted({*plain_bag("b"), *plain_bag("c")})
    idf = np.log(4 / 2) + 1
    emb = rng.uniform(-1 / X.DIM, 1 / X.DIM, (len(used), X.DIM)).astype(np.float32).astype(float)
    soft, bias = np.zeros((X.DIM, 2)), np.zeros(2)
    g_emb, g_soft, g_bias = np.full(len(used), 1e-6), np.full((X.DIM, 2), 1e-6), np.full(2, 1e-6)
    epochs = max(2, round(64 / 4))
    for epoch in range(epochs):
        order = rng.permutation(4)
        rng.random(4)
        step = 0.1 * (1 - epoch / epochs)
        d_emb, d_soft, d_bias = np.zeros_like(emb), np.zeros_like(soft), np.zeros(2)
        for r in order:
            bag = plain_bag(texts[r])
            hidden = sum(w * idf * emb[used.index(b)] for b, w in bag.items())
            z = hidden @ soft + bias
            prob = np.exp(z - z.max())
            prob /= prob.sum()
            prob[labels[r]] -= 1
            prob /= 4
            d_soft += np.outer(hidden, prob)
            d_bias += prob
            for b, w in bag.items():
                d_emb[used.index(b)] += w * idf * (soft @ prob)
        d_soft += 1e-5 * soft
        g_emb += (d_emb**2).mean(1)
        g_soft += d_soft**2
        g_bias += d_bias**2
        emb -= step * d_emb / np.sqrt(g_emb)[:, None]
        soft -= step * d_soft / np.sqrt(g_soft)
        bias -= step * d_bias / np.sqrt(g_bias)
    assert model.weight[used] == pytest.approx((emb @ (soft[:, 1] - soft[:, 0])) * idf, rel=1e-3)
    assert model.bias == pytest.approx(bias[1] - bias[0], abs=1e-6)


def test_long_texts_are_learned_whole(spark):
    """All toxic texts are long, with the only toxic word at their end."""
    rng = random.Random(1)
    plain = "walk tree paper window garden letter music stone water evening".split()
    rows = [(i, " ".join(rng.choice(plain) for _ in range(6000)) + (" vlorking vlorked" * 300 if i % 3 == 0 else "")) for i in range(90)]
    docs = spark.createDataFrame([*rows, (500, "vlorkers walk"), (501, "water evening")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in X.score_toxicity(docs, model, 0.5).collect()}
    assert all(got[i] == int(i % 3 == 0) for i in range(90)) and (got[500], got[501]) == (1, 0)


def test_the_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "train", lambda texts, labels, **_: seen.append((texts, labels)))
    docs = spark.createDataFrame([(i, f"short {i}") for i in range(3000)] + [(5, "again")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1500)) for i in range(3000)] + [(5, 1)] * 900, "doc_id long, toxic int")
    X.fit(docs, labels, rows=10)
    texts, given = seen[0]
    assert given.count(1) == 10 and given.count(0) == 20 and len(set(texts)) == 30
