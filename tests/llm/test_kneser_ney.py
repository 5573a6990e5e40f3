from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_cases import EDGE
from lossloom.llm import kneser_ney as K
from lossloom.llm.wordhash import mix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "</s>"]


class Plain:
    def __init__(self, texts):
        self.c = Counter(w for t in texts for w in tokens(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter(p for t in texts for p in zip(["<s>", *tokens(t)], tokens(t)))
        self.cont = Counter(w for _, w in self.pairs)
        of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.d, self.e = K.discounts(of(self.pairs)), K.discounts(of(self.cont))
        self.total, self.kinds = Counter(), defaultdict(lambda: [0, 0, 0, 0])
        for (u, _), c in self.pairs.items():
            self.total[u] += c
            self.kinds[u][min(c, 3)] += 1
        self.k = sum(self.cont.values())
        self.rest = sum(self.e[min(c, 3)] for c in self.cont.values()) / max(self.k, 1)

    def p(self, u, w):
        low = max(self.cont[w] - self.e[min(self.cont[w], 3)], 0) / self.k + self.rest / (self.v + 1)
        if not self.total[u]:
            return low
        c = self.pairs[u, w]
        return (max(c - self.d[min(c, 3)], 0) + low * sum(self.d[i] * self.kinds[u][i] for i in (1, 2, 3))) / self.total[u]

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in t)
        return len(t), sum(self.c[w] > 0 for w in t), self.n, base, sum(math.log10(self.p(u, w)) for u, w in zip(["<s>", *t], t))


@pytest.mark.parametrize("parts", [None, 3])
def test_matches_brute_force(docs, corpus, monkeypatch, parts):
    if parts:
        monkeypatch.setattr(K, "BUFFERED", 500)
    train = [(r[0], r[1]) for r in corpus[::2]] + [(1, "the " * 400)]
    held = [(10_000 + i, r[1]) for i, r in enumerate(corpus[1::2])] + EDGE
    plain = Plain([t for _, t in train])
    assert abs(sum(plain.p("the", w) for w in plain.c) + plain.p("the", "unseen!") - 1) < 1e-9
    folder = K.train(docs(train))
    got = K.score(docs(held + train), folder).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6), round(r[5], 6))
    want = sorted(((k, *plain.row(t)) for k, t in held + train), key=key)
    for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_empty_training_and_empty_input(docs):
    folder = K.train(docs([]))
    (r,) = K.score(docs([(1, "a b")]), folder).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])
    assert K.score(docs([]), K.train(docs([(1, "a")]))).collect() == []


def test_keys_and_counts_are_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    assert np.array_equal(K.unmix(mix(x)), x)
    counts = rng.integers(1, 1000, 500).astype(np.uint64)
    assert np.array_equal(K._wide(K._small(counts), 500), counts)
    with pytest.raises(ValueError):
        K._local("hdfs://somewhere/x")
