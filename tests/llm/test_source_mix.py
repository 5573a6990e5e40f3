from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

from llm_cases import EDGE
from lossloom.llm import source_mix as M


def water(sizes, weights, share=1.5, cap=2.0):
    """Sharing by weight and resharing the excess, round by round."""
    total, fixed = share * sum(sizes), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i] + 1e-9]
        if not over:
            return [fixed[i] if i in fixed else left * weights[i] / w for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for k, text, source in rows:
        t = text or ""
        u = (int(hashlib.md5(f"mix-1:{'null' if k is None else k}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        w = max(0.1, 1 - 2 * len(re.findall(r"[!-/:-@\[-`{-~]", t)) / max(len(t), 1))
        by[source].append((-math.log(u) / w, -1 if k is None else k, size(t), k))
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    sizes = [sum(d[2] for d in by[s]) for s in names]
    targets = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    out = []
    for s, total, target in zip(names, sizes, targets, strict=True):
        epochs = math.floor(target / total) if total else 1
        left, run = target - epochs * total, 0
        for _, _, n, k in sorted(by[s]):
            times = epochs + (left > 0 and run + n / 2 <= left)
            out.append((k, n, total, target if total else 0.0, times * n))
            run += n
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-6) for a, b in zip(got, want, strict=True))


def test_matches_brute_force(docs, corpus):
    for rows in (corpus, [(*r, s) for r, s in zip(EDGE, ["b", None, "a", "c", None, "é", "é", "z", "b", "a", "Z", "b", "b"], strict=True)],
                 [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i}") for i in range(200)]):
        for per_cell in (1, 10, 20_000):
            got = M.sample(docs(rows).withColumnRenamed("size", "SIZE2"), rows_per_cell=per_cell).drop("times").collect()
            same(got, brute(rows))
    assert M.sample(docs([])).collect() == []


def test_sources_come_near_their_targets(docs, corpus):
    per = defaultdict(lambda: [0, 0, 0.0])
    for r, (_, _, s) in zip(sorted(M.sample(docs(corpus)).collect()), sorted(corpus), strict=True):
        assert r["taken"] <= 2 * r["size"]
        per[s][0] += r["taken"]
        per[s][1] = max(per[s][1], r["size"])
        per[s][2] = r["target"]
    assert all(abs(taken - target) <= largest for taken, largest, target in per.values())


def test_cells_stay_even_when_weights_are_skewed(spark, docs):
    """Nearly all rows at the least weight, whose keys reach far beyond the others'."""
    from pyspark.sql import functions as F

    rows = docs([(i, "!?" * 20 if i % 20 else "plain words here", "hot") for i in range(6000)]).select(
        (-F.log(M.uniform("doc_id")) / M.quality_weight(F.col("text"))).alias("_key"), M.quality_weight(F.col("text")).alias("_w"))
    cell = F.floor(M.distribution(rows, F.col("_key")) * 30)
    sizes = [r["count"] for r in rows.groupBy(cell.alias("c")).count().collect()]
    assert len(sizes) == 30 and max(sizes) <= 1.3 * 200
