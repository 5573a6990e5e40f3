from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lossloom.llm import nn_descent as N
from lossloom.llm.common import importable

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, top=20, step=20):
    """query id -> [(score, id)] in order, with the rules of the docstring."""
    live = {(k, tuple(v)) for k, _, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    if not live:
        return {}
    widths = [len(v) for _, v in live]
    width = max(set(widths), key=lambda w: (widths.count(w), w))
    live = [(k, np.array(v)) for k, v in live if len(v) == width]
    out = {}
    for q in {k for k, _ in live if k % step == 0}:
        score = {}
        for k, v in live:
            if k != q:
                score[k] = max(score.get(k, -math.inf), *(float(v @ w) for j, w in live if j == q))
        out[q] = sorted(((-s, k) for k, s in score.items()))[:top]
    return {q: [(-s, k) for s, k in v] for q, v in out.items()}


def got(spark, rows, **kw):
    importable(spark)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("node", "u", "v", "score", "rank", "near", "ids")})
    out = N.nearest(df.repartition(3), **kw)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    answers = {}
    for q, rank, k, s in sorted(map(tuple, out.collect())):
        assert rank == len(answers.setdefault(q, [])) + 1
        answers[q].append((s, k))
    return answers


def recall(answers, want):
    """Share of the wanted rows found, a row of the same score counting as well; every score given must be exact."""
    hits = total = 0
    for q, right in want.items():
        low = right[-1][0] if right else 0
        hits += sum(s >= low - 1e-9 for s, _ in answers.get(q, []))
        total += len(right)
    return hits / total


def test_edges_are_answered_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.normal(size=4).tolist()) for i in range(1, 30)]
    rows += [(None, 1, [1.0] * 4), (20, 1, None), (40, 1, [0.0] * 4), (60, 1, [1.0, None, 0.0, 0.0]), (80, 1, [math.nan] * 4), (100, 1, [math.inf, 0.0, 0.0, 0.0]), (120, 1, []),
             (140, 1, [1.0, 2.0]), (160, 1, [1.0, 0.0, 0.0, 0.0]), (160, 1, [1.0, 0.0, 0.0, 0.0]), (180, 1, [0.0, 1.0, 0.0, 0.0]), (180, 2, [0.0, 0.0, 1.0, 0.0]), (-20, 0, [1e3, 0.0, 0.0, 1.0])]
    rows += [(1000 + i, 0, [2.0, 0.0, 0.0, 0.0]) for i in range(60)]  # one vector, many ids: the least answer
    answers, want = got(spark, rows), brute(rows)
    assert answers.keys() == want.keys()
    for q in want:
        assert [k for _, k in answers[q]] == [k for _, k in want[q]]
        assert np.allclose([s for s, _ in answers[q]], [s for s, _ in want[q]])
    assert got(spark, []) == {}
    assert got(spark, [(20, 1, [1.0]), (21, 1, [-1.0])]) == {20: [(-1.0, 21)]}


def test_recall(spark):
    """Directions around centres, of lengths that differ by an order of magnitude."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 32))
    v = centres[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 32))
    v *= np.exp(rng.normal(size=(3000, 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, 0, x.tolist()) for i, x in enumerate(v)]
    answers, want = got(spark, rows), brute(rows)
    assert recall(answers, want) >= 0.95
    for q, right in answers.items():
        assert len(right) == 20 and all(math.isclose(s, float(v[q] @ v[k]), rel_tol=1e-12) for s, k in right)


def test_groups_are_compared_like_brute_force():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 40, 30)
    group, n = np.repeat(np.arange(30), sizes), int(sizes.sum())
    node, x = rng.permutation(n), rng.normal(size=(n, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    new, bar = rng.random(n) < 0.4, rng.uniform(-1, 0.3, n).astype(np.float32)
    u, v, s = N.compared(group, node, x, new, bar, 1000)
    want = {(node[i], node[j]): float(x[i] @ x[j]) for i in range(n) for j in range(n)
            if i != j and group[i] == group[j] and (new[i] or new[j]) and x[i] @ x[j] > bar[i] + 1e-5}
    found = dict(zip(zip(u.tolist(), v.tolist(), strict=True), s.tolist(), strict=True))
    assert want.keys() <= found.keys() and all(abs(found[k] - want[k]) < 1e-5 for k in want)
    assert len(N.compared(group, node, x, new, bar, 3)[0]) < len(u)
