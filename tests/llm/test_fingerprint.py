from __future__ import annotations

import hashlib
import random

import pytest

from llm_cases import EDGE
from lossloom.llm import fingerprint as P


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (k, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        prefix = next((j for j, (a, b) in enumerate(zip(text, after)) if a != b), min(len(text), len(after)))
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), prefix))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("rows_per_bucket", [1, 7, 2000])
def test_edited_texts_match_brute_force(docs, corpus, rows_per_bucket):
    rows = [(r[0], r[1]) for r in corpus] + [(10_000 + k if k is not None else None, t) for k, t in EDGE]
    out = P.fingerprints(docs(rows), rows_per_bucket=rows_per_bucket).collect()
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["shared_prefix"]) for r in out), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert got == expected(rows)
    texts, prints = {}, {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_id = dict(rows)
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 10_000:
            texts.setdefault(by_id[r["doc_id"]], set()).add(r["fingerprint"])
            prints.setdefault(r["fingerprint"], set()).add(by_id[r["doc_id"]])
    assert all(len(v) == 1 for v in texts.values()) and all(len(v) == 1 for v in prints.values())


def test_lone_row_and_no_rows(docs):
    (r,) = P.fingerprints(docs([(1, "abcdefgh")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdabcd").hexdigest() and r["near_next"] == 1.0
    assert P.fingerprints(docs([])).collect() == []


def test_spans_and_extensions_match_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        a, b = ("".join(rng.choice("ab𝔘") for _ in range(rng.randint(1, 60))) for _ in range(2))
        x, y = P.PrefixHash(P.code_points(a)), P.PrefixHash(P.code_points(b))
        for _ in range(30):
            i, j = rng.randrange(len(a)), rng.randrange(len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert x.same(i, y, j, n) == (a[i:i + n] == b[j:j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert x.extension(i, y, j) == k


def test_likeness_estimates_the_shared_spans():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij ") for _ in range(6000))
    for share in (0.0, 0.3, 0.7, 1.0):
        n = int(len(text) * share)
        other = text[:n] + "".join(rng.choice("klmnopqrst ") for _ in range(len(text) - n))
        a, b = ({t[i:i + P.SPAN] for i in range(len(t) - P.SPAN + 1)} for t in (text, other))
        got = P.likeness(*(P.PrefixHash(P.code_points(t)).fingerprint() for t in (text, other)))
        assert abs(got - len(a & b) / len(a | b)) < 0.2
