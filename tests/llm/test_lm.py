from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import corpus, frame, words
from tidewire.llm import lm_score


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 10 == 0


@pytest.mark.parametrize("head", [1 << 16, 50])
def test_base_scores_equal_brute_force_and_the_model_is_better(spark, head):
    rows = [(k, t) for k, t in corpus()] + [(300 + k, f"{t} {t}" if t and len(t) < 2000 else t) for k, t in corpus(9)]
    tokens = [(d, [*words(t), None]) for d, t in rows]
    c = Counter(w for d, ws in tokens if not held_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    out = lm_score.lm_scores(frame(spark, rows), head=head).collect()
    assert len(out) == len(rows) and {r["train_tokens"] for r in out} == {n}
    want = sorted((d, held_out(d), len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in tokens)
    got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in out)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4]))
    test = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    vocabulary = [lm_score.END, *(b"w%d" % k for k in range(300))]
    classes = rng.integers(1, lm_score.CLASSES, lm_score.BUCKETS)
    classes[0] = 0
    model = lm_score.Model(vocabulary, rng.integers(1, 50, 301).astype(float), classes, 1000, 301, rng.normal(size=(lm_score.FEATURES, lm_score.CLASSES)).astype(np.float32))
    counts = rng.integers(0, 9, (lm_score.CLASSES, model.head + lm_score.CLASSES)).astype(float)
    table = lm_score.fit_in_class(counts, model.class_of_id)
    ids = rng.integers(0, 300, 20)
    kinds = model.class_of_id[ids]
    by_class = np.exp(lm_score.log_softmax(model.weights, lm_score.features(ids, kinds)))
    before = np.concatenate([[0], kinds[:-1]])
    whole = (by_class[:, model.class_of_id] * 10.0 ** table[before]).sum(axis=1)
    assert np.allclose(whole, 1, atol=1e-4)


def test_empty_and_null(spark):
    assert lm_score.lm_scores(frame(spark, [])).count() == 0
    out = lm_score.lm_scores(frame(spark, [(1, None), (2, ""), (2, "")])).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == [(1, 1), (2, 1), (2, 1)]


@pytest.mark.parametrize("pairs", [1 << 20, 300])
def test_pairs_of_words_reach_the_words(spark, monkeypatch, pairs):
    monkeypatch.setattr(lm_score, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    words_in_order = [f"{a}{b}end" for a in "bcdfghklmn" for b in "aeiouyrstw"]  # one spelling of the end: one class

    def text(in_order):
        k = rng.integers(100, size=60) if not in_order else (rng.integers(100) + np.arange(60)) % 100
        return " ".join(words_in_order[i] for i in k)

    held = [d for d in range(2000) if held_out(d)][:40]
    rows = [(d, text(True)) for d in range(300) if not held_out(d)] + [(d, text(k % 2 == 0)) for k, d in enumerate(held)]
    scores = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_score.lm_scores(frame(spark, rows)).collect()}
    assert len(scores) == len(rows)
    assert np.mean([scores[d] for d in held[::2]]) > np.mean([scores[d] for d in held[1::2]]) + 1


def test_gains_of_a_context_keep_its_sum():
    rng = np.random.default_rng(2)
    inside = np.log10(rng.dirichlet(np.ones(50), 8)).ravel()
    n = rng.integers(0, 4, 400) * rng.integers(0, 9, 400)
    total = np.repeat(n.reshape(8, 50).sum(axis=1), 50)
    whole = 10.0 ** (inside + lm_score.gains(n, total, inside))
    assert np.allclose(whole.reshape(8, 50).sum(axis=1), 1, atol=1e-4)


def test_split_texts_like_bytes_split():
    texts = [b"", b"  a B\tc.\n", b"\x0b\x0c", b"x", "Ünï. cödé\u00a0t".encode(), b"one, two!? ..."]
    got, lengths = lm_score.split_texts(texts)
    assert got.to_pylist() == [w for t in texts for w in t.lower().split()]
    assert lengths.tolist() == [len(t.split()) for t in texts]
