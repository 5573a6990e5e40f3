from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import EDGE
from lossloom.llm import jaccard_join as J
from lossloom.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            near = len(a & b) >= threshold * len(a | b) - 1e-9 if a and b else not a and not b and (rows[i][1] or "") == (rows[j][1] or "")
            if near:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    low = {r: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for r, m in members.items()}
    return [(rows[i][0], low[find(i)], links[i], len(members[find(i)])) for i in range(len(rows))]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_matches_brute_force(docs, corpus):
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in corpus] + [(10_000 + i if k is not None else k, t) for i, (k, t) in enumerate(EDGE)]
    seed = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    rows += [(20_000 + i, edited(rng, seed, rng.randint(0, 6))) for i in range(60)]
    rows += [(30_000 + i, " ".join(f"w{rng.randrange(900)}" for _ in range(80)) + " " + seed[:200]) for i in range(60)]
    same(J.join(docs(rows)).collect(), brute(rows))


@pytest.mark.parametrize(("limit", "max_depth"), [(8, 2), (4, 4)])
def test_large_buckets_lose_nothing(docs, limit, max_depth):
    rng = random.Random(7)
    seed = " ".join(f"w{rng.randrange(500)}" for _ in range(150))
    rows = [(i, edited(rng, seed, i % 5)) for i in range(70)]
    same(J.join(docs(rows), limit=limit, max_depth=max_depth, block=9).collect(), brute(rows))


def test_intersections_match_brute_force(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for cells in (1 << 23, 100):
        monkeypatch.setattr(J, "CELLS", cells)
        assert J.shared(sets).tolist() == want


def test_no_rows(docs):
    assert J.join(docs([])).collect() == []
    assert J.runs_for(0.999, 4) > J.runs_for(0.9, 4) > 1 and J.runs_for(0.999, 8) > J.runs_for(0.999, 4)


def test_rows_without_or_with_repeated_ids_take_part(docs):
    rng = random.Random(8)
    seed, other = (" ".join(f"{p}{rng.randrange(500)}" for _ in range(120)) for p in "uv")
    rows = [(None, edited(rng, seed, 1)) for _ in range(4)] + [(5, edited(rng, seed, 1)), (5, other), (5, edited(rng, other, 1)), (None, "!!"), (None, "!!"), (7, "?"), (None, None), (8, "")]
    same(J.join(docs(rows)).collect(), brute(rows))
    stay = Counter(r["doc_id"] for r in J.survivors(docs(rows)).collect())
    assert stay == {5: 2, None: 1, 7: 1, 8: 1}  # two classes have 5 as their least id


def test_pairs_at_the_threshold_are_met_in_oversized_buckets(docs):
    """All texts share a long passage, so that buckets stay above the limit for many steps; each has one partner at 0.8 or little more."""
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(110))
    rows = []
    for i in range(150):
        own = [f"d{i}x{j}" for j in range(110)]
        twin = list(own)
        twin[40:58] = [f"e{i}x{j}" for j in range(18)]
        rows += [(2 * i, f"{common} {' '.join(own)}"), (2 * i + 1, f"{common} {' '.join(twin)}")]
    a, b = shingle_set(rows[0][1]), shingle_set(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.83
    rng.shuffle(rows)
    met = {r["doc_id"] for r in J.join(docs(rows), limit=24).collect() if r["n_links"]}
    assert len(met) >= 0.99 * len(rows)


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    assert set(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == want


def test_texts_travel_in_bounded_batches(spark, docs):
    """10,000 rows a batch, Spark's only bound by default, put the whole of many long texts into the memory of a task and its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        spark.conf.unset(key)
        J.survivors(docs([(1, "one two three four five six"), (2, "seven")])).collect()
        long = spark.range(0, 24, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text")
        got = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 24_000_000 and max(got) < 8_000_000
        spark.conf.set(key, "2m")
        J.survivors(docs([(1, "one two three four five six")])).collect()
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
