from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from llm_cases import EDGE
from lossloom.llm import exact_dedup as D


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = Counter()
    for k, text in ((r[0], r[1] or "") for r in rows):
        keep = max((i for i in groups[text] if i is not None), default=None)
        out[k, keep, len(groups[text]), k == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_assign_matches_brute_force(docs, corpus):
    for rows in (EDGE, [(r[0], r[1]) for r in corpus] + EDGE, [(i, "copy") for i in range(300)] + [(1000, "other")], []):
        assert Counter(map(tuple, D.assign(docs(rows)).collect())) == expected(rows)


def test_texts_that_share_a_digest_stay_apart(docs):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(99, None)]
    weak = D.assign(docs(rows), digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1).isNull().cast("string"))
    assert Counter(map(tuple, weak.collect())) == expected(rows)


def test_survivors_keep_one_whole_row(docs):
    out = D.survivors(docs(EDGE, extra=False), ["doc_id", "text", "lang", "source", "n_chars"]).collect()
    assert len(out) == len({r[1] or "" for r in EDGE})
    assert {(r["doc_id"], r["text"]) for r in out} >= {(9, "a b c d e f"), (4, "word"), (4, "other word"), (2, "")}


def test_no_python_in_the_plan(docs):
    plan = D.survivors(docs([(1, "a")]), ["doc_id", "text"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan
