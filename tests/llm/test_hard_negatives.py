from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossloom.llm import hard_negatives as H
from lossloom.llm.common import importable

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows):
    live = []
    for k, label, v in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (k, int(math.fmod(label + 1, 10)) if k % 7 == 0 else label, tuple(math.floor(256 * x) for x in v))
        live.append(row)
    out = []
    for a, la, va in {r for r in live if r[0] % 100 == 0}:
        scored = {(-max(min(sum(x * y for x, y in zip(va, v)), 2**63 - 1), -2**63), k, lab == la) for k, lab, v in live if k != a}  # noqa: B905
        positives = sorted({(s, k) for s, k, same in scored if same})[:5]
        for p, pk in positives:
            window = sorted({(s, k) for s, k, same in scored if not same and -p * 80 <= -s * 100 <= -p * 100})[:5]
            out += [(a, pk, i + 1, k, -p, -s) for i, (s, k) in enumerate(window)]
    return sorted(out)


def got(spark, rows, **kw):
    importable(spark)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("place", "v", "tree", "slot", "score", "rank")})
    out = H.mine(df.repartition(3), **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def clustered(rng, n, dim=6, centres=4):
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i * 10, rng.randrange(3), [x + rng.gauss(0, 0.3) for x in rng.choice(base)]) for i in range(n)]


EDGE = [(None, 1, [1.0]), (100, None, [1.0]), (200, 1, None), (300, 1, [1.0, None]), (400, 2, [math.nan]), (500, 2, [math.inf, 0.0]), (600, 1, []), (700, 1, [0.0] * 6),
        (800, 2, [1.0, 2.0]), (801, 2, [1.0, 2.0]), (801, 2, [1.0, 2.0]), (801, 1, [1.0, 2.0]), (900, 9, [-1.0] * 6), (900, 9, [-1.0] * 6), (900, 1, [2.0] * 6), (-100, -3, [1.0] * 6),
        (-7, -2, [1.0] * 6), (802, 2, [0.9, 1.9]), (803, 2, [0.9, 1.9])]


@pytest.mark.parametrize(("block", "pass_bytes"), [(512, 32 << 20), (3, 300), (1, 1)])
def test_matches_brute_force(spark, block, pass_bytes):
    rows = clustered(random.Random(block), 250) + EDGE + [(5000 + i, 1, [0.5] * 6) for i in range(30)]
    want = brute(rows)
    assert len(want) > 100 and got(spark, rows, block=block, pass_bytes=pass_bytes) == want


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i * 50, i % 2, [rng.choice([1, 2.0**20, 2.0**28]) * rng.random() for _ in range(4)]) for i in range(24)]
    rows += [(7000 + i, i % 2, [1e300 * (i - 2), 3.0, 0.0, 1.0]) for i in range(4)]
    assert got(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert got(spark, []) == [] and got(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []


def test_bounds_hold_and_spare_products():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 400, (8, 12))
    v = np.floor(centres[rng.integers(0, 8, 3000)] + rng.normal(0, 4, (3000, 12)))
    ids, labels = np.arange(3000), rng.integers(0, 2, 3000)
    block = H.Block(np.arange(64), ids[:64] + 10_000, labels[:64], v[:64])
    parent, length, levels = block.parent, block.length, block.levels
    assert sorted(np.concatenate(levels).tolist()) == list(range(64)) and (parent == -1).sum() == 1
    for i in np.flatnonzero(parent >= 0):
        assert np.isclose(length[i], np.linalg.norm(v[i] - v[parent[i]]))
    scorer = H.Scorer(block, None)
    for lo in range(0, 3000, 500):
        scorer.add(ids[lo:lo + 500], labels[lo:lo + 500], v[lo:lo + 500])
    slot, found, score = scorer.kept.rows()
    for a in range(64):
        s = v @ v[a]
        want = sorted((-int(s[c]), c) for c in range(3000) if labels[c] == labels[a])[:5]
        assert [(-x, k) for x, k in zip(score[slot == a].tolist(), found[slot == a].tolist(), strict=True)] == want
    assert scorer.scored < 0.7 * scorer.seen
