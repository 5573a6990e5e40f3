from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as C
from lossloom.llm import bpe
from lossloom.llm.common import table
from llm_cases import EDGE, SF
from test_jaccard_join import brute as near_brute
from test_jaccard_join import shingle_set
from test_source_mix import brute as mix_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_against_brute_force(spark):
    # The smallest labels table holds about 70 training rows; the next one is large enough to ask for accuracy.
    more = SF.replace("sf0.001", "sf0.01")
    kept = C.quality(spark, table(spark, more, "documents"), more)
    assert kept.columns == COLUMNS
    quality = {r["doc_id"]: r["quality"] for r in table(spark, more, "labels").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    good = [k for k, y in quality.items() if y == 1]
    assert sum(k in ids for k in good) >= 0.98 * len(good)
    assert sum(k not in ids for k, y in quality.items() if y == 0) >= 0.85 * sum(y == 0 for y in quality.values())

    docs = table(spark, SF, "documents")
    exact = C.exact(spark, docs, SF)
    last = {}
    for k, t, _ in rows_of(docs):
        last[t or ""] = max(k, last.get(t or "", k))
    assert exact.columns == COLUMNS and Counter(r["doc_id"] for r in exact.collect()) == Counter(last.values())

    near = C.near(spark, docs, SF)
    want = {c for _, c, _, _ in near_brute([(k, t) for k, t, _ in rows_of(docs)])}
    assert near.columns == COLUMNS and Counter(r["doc_id"] for r in near.collect()) == Counter(want)

    mixed = C.mix(spark, docs, SF)
    words = Counter()
    for k, t, _ in rows_of(mixed):
        words[k] += len((t or "").split())
    assert mixed.columns == COLUMNS and words == Counter({k: taken for k, _, _, _, taken in mix_brute(rows_of(docs)) if taken})

    out = C.encode(spark, docs, SF).collect()
    coder = bpe.PairIndexBPE(C.public_tokenizers.path("word_bpe_49k.json"))
    texts = {k: t or "" for k, t, _ in rows_of(docs)}
    assert len(out) == len(texts) and all(bytes(r["ids"]) == coder.encode([texts[r["doc_id"]]])[0] for r in out[:50])


def test_run_and_empty_table(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0
    assert 4 <= len(C.STAGES) <= 5
    empty = table(spark, SF, "documents").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_clashing_names_null_and_repeated_ids(spark, docs):
    rng = random.Random(4)
    seed = " ".join(f"w{rng.randrange(400)}" for _ in range(120))
    rows = [*EDGE, (None, seed), (None, seed + " end"), (None, "another text of five words"), (1, seed), (1, "a second text under one id"), (1, seed)]
    extra = ("score", "predicted", "held_out", "_held", "_id", "_times", "times", "whole", "key", "id", "rest", "c0", "quality", "_y", "root", "n", "_s", "target")
    df = docs(rows).withColumns({c: F.lit(f"<{c}>") for c in extra})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        got = out.collect()
        assert all(r[c] == f"<{c}>" for r in got for c in extra), name
        assert {(r["doc_id"], r["text"] or "") for r in got} <= {(k, t or "") for k, t in rows}, name
        if name == "near_dedup":
            # One class holds all copies of the long text: its least id stays, and no row without one.
            assert Counter(r["doc_id"] for r in got if (r["text"] or "").startswith(seed)) == {1: 1}
            assert Counter((r["doc_id"], r["text"]) for r in got)[(None, "another text of five words")] == 1
            assert Counter(r["doc_id"] for r in got) == Counter(near_stay(rows))
    assert C.encode(spark, df, SF).count() == len(rows)


def near_stay(rows):
    """Ids of the rows that stay: one per class, the least id, None only without any."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) >= 0.8 * len(a | b) - 1e-9) if a and b else (not a and not b and (rows[i][1] or "") == (rows[j][1] or "")):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        members[find(i)].append(k)
    return [min((k for k in m if k is not None), default=None) for m in members.values()]
