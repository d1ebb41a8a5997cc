"""op1 against the model worked out with dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import DATA, clash, documents, sample_texts, space_words

from tastemap.llm import katz
from tastemap.llm.common import crc_fold

COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
START, END, UNKNOWN = ("start",), ("end",), ("unknown",)


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def distribution(counts, d):
    """({item: probability}, what is left)"""
    total = sum(counts.values())
    p = {w: (d[c] if c <= katz.K else 1.0) * c for w, c in counts.items()}
    left = total - sum(p.values())
    if left <= 1e-12 * total:
        total, left = total + 1, 1.0
    return {w: x / total for w, x in p.items()}, left / total


class Brute:
    def __init__(self, rows):
        self.unigrams, self.bigrams = Counter(), defaultdict(Counter)
        for doc, text in rows:
            if not held(doc):
                tokens = [*space_words(text), END]
                self.unigrams.update(tokens)
                for h, w in zip([START, *tokens], tokens):
                    self.bigrams[h][w] += 1
        of = lambda cs: katz.discounts(np.bincount([c for c in cs if c <= katz.K + 1], minlength=katz.K + 2))
        self.p, self.unknown = distribution(self.unigrams, of(self.unigrams.values())) if self.unigrams else ({}, 1.0)
        d = of([c for x in self.bigrams.values() for c in x.values()])
        self.seen, self.alpha = {}, {}
        for h, counts in self.bigrams.items():
            self.seen[h], left = distribution(counts, d)
            self.alpha[h] = left / (1 - sum(self.p[w] for w in counts))

    def probability(self, w, h):
        if w in self.seen.get(h, ()):
            return self.seen[h][w]
        return self.alpha.get(h, 1.0) * self.p.get(w, self.unknown)

    def row(self, doc, text):
        tokens = [*space_words(text), END]
        n, v = sum(self.unigrams.values()), len(self.unigrams)
        base = sum(math.log10((self.unigrams[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        score = sum(math.log10(self.probability(w, h)) for h, w in zip([START, *tokens], tokens))
        known = sum(t in self.unigrams for t in tokens)
        return (doc, held(doc), len(tokens), known, n), base, score


def check(got, rows):
    model = Brute(rows)
    expected = sorted((model.row(*r) for r in rows), key=str)
    found = sorted(((tuple(r[c] for c in COLUMNS), r.base_score, r.score) for r in got.collect()), key=str)
    assert [f[0] for f in found] == [e[0] for e in expected]
    for f, e in zip(found, expected):
        assert np.allclose(f[1:], e[1:], rtol=1e-9, atol=1e-9), (f, e)
    return model


def score(spark, df):
    return katz.score(df, crc_fold("doc_id", 10) == 0)


@pytest.mark.parametrize("block,part", [(2_000_000, 1_000_000), (300, 200)])
def test_equals_dictionaries(spark, monkeypatch, block, part):
    monkeypatch.setattr(katz, "BLOCK", block)
    monkeypatch.setattr(katz, "PART", part)
    rows = list(enumerate(sample_texts(150, seed=11, vocabulary=150, longest=60)))
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, "a b unseen"), (10**12, "unseen words only here")]
    model = check(score(spark, clash(documents(spark, rows).repartition(3))), rows)
    words = [*model.unigrams, UNKNOWN]
    for h in [*model.bigrams, UNKNOWN]:
        assert abs(sum(model.probability(w, h) for w in words) - 1) < 1e-9


@pytest.mark.parametrize(
    "texts",
    [[], [None], ["a"], ["a a a a a a a a a a"] * 12, ["x y", None, "", "x z", "X Y"] * 5, ["a b c"] * 40 + ["z q"] * 3],
)
def test_small_corpora(spark, texts):
    rows = list(enumerate(texts))
    check(score(spark, documents(spark, rows)), rows)


def test_packing_of_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        h, w = rng.integers(0, 30, n), rng.integers(0, 10**9, n)
        order = np.lexsort((w, h))
        a, b = katz.unpack_pairs(*katz.pack_pairs(h[order], w[order]))
        assert np.array_equal(a, h[order]) and np.array_equal(b, w[order])


def test_good_turing():
    n = np.array([0, 1000, 400, 220, 140, 100, 75])
    d = katz.discounts(n)
    excess = 6 * 75 / 1000
    assert np.allclose(d[1], (2 * 400 / 1000 - excess) / (1 - excess))
    assert ((0 < d[1:]) & (d[1:] < 1)).all() and (np.diff(d[1:]) > 0).all()


def test_query_beats_the_base(spark):
    from tastemap.llm import QUERIES

    got = QUERIES["op1_katz"](spark, f"{DATA}/sf0.001")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    check(got, rows)
    out = [r for r in got.collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
