from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lossloom.llm import prefix_trie as P
from lossloom.llm.common import importable, table
from llm_cases import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(own.get(first, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, len(seq) == d))
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not children[k]
        saved[k] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    return sorted(((m[0][0], len(k), members[k[:-1]][0][0] if k else None, len(m), len(children[k]), leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c, end in m if end).encode()).hexdigest()) for k, m in members.items()), key=str)


def got(spark, rows, per_shard):
    importable(spark)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("codes", "sizes", "key", "_h", "n", "depth", "said")})
    out = P.prefix_trie(df, per_shard)
    assert out.columns == P.COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


EDGE = [(None, 1, "user", "lost"), (0, None, "user", "first"), (0, 0, None, None), (0, 1, "", ""), (1, 0, "user", "x" * 100_000), (3, 2, "user", "Ünï 𝔘"), (3, 1, "a", "b"),
        (3, 1, "a", "b"), (7, 0, "user", "no head"), (-3, 0, "user", "below"), (-5, 0, "user", "below head"), (12, 4, "u", "s"), (12, 4, "u", "s")]


@pytest.mark.parametrize("per_shard", [1, 7, 60, 10_000])
def test_matches_brute_force(spark, per_shard):
    rng = random.Random(per_shard)
    rows = [(c + 20, t, rng.choice(["user", "bot"]), rng.choice(["", "a", "bb", "é"])) for c in range(60) for t in range(rng.choice([1, 2, 3, 9, 14]))]
    rows += [(c, t, "user", f"the same {t}") for c in range(200, 230) for t in range(10)] + EDGE
    rng.shuffle(rows)
    assert got(spark, rows, per_shard) == brute(rows)


def test_long_conversation_and_smallest_table(spark):
    rows = [(5 * c, t, "user", f"{t % 3}") for c in range(3) for t in range(1500)]
    assert got(spark, rows, 500) == brute(rows)
    importable(spark)
    full = [tuple(r) for r in table(spark, SF, "conversations").collect()]
    assert got(spark, full, 20) == brute(full)
    assert got(spark, [], 10) == [] and got(spark, [(None, 0, "user", "x")], 10) == []


def test_median_order_balances_siblings():
    assert sorted(P.median_order(100)) == list(range(100))
    tree = P.TernaryTree()
    for i in P.median_order(1023):
        tree.insert([i], [1], [i])
    deep = {tree.below[0]: 1}
    for node in range(1, len(tree.code)):
        for child in (tree.low[node], tree.high[node]):
            if child >= 0:
                deep[child] = deep[node] + 1
    assert max(deep.values()) == 10
