from __future__ import annotations

import random
import re

from lossloom.llm import license_scan as L
from llm_cases import EDGE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    ws, hits, labels = words(text), [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i:i + len(p)] == p]
        hits += at
        labels |= {label} if at else set()
    return len(ws), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def check(spark_rows, texts):
    for r in spark_rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]]), r["doc_id"]
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_base_columns_match_brute_force(docs, corpus):
    rng = random.Random(5)
    vocabulary = sorted({w for p, _ in L.BASE for w in p.split()} | {"the", "of", "Zebra", "free", "software", "under"})
    made = [(10_000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    made += [(20_000, "CC-BY/MIT_License: Apache\u0000LICENSE. apache apache license license gnu general public license cc by by cc by")]
    rows = [(r[0], r[1]) for r in corpus] + made
    check(L.scan(docs(rows)).collect(), dict(rows))


def test_edge_rows(docs):
    out = L.scan(docs(EDGE)).collect()
    assert len(out) == len(EDGE) and all(r["n_base"] == 0 and r["labels"] == "" and r["score"] == 0.0 for r in out)
    assert L.scan(docs([])).collect() == []


def test_matching_statistics_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        seqs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))]
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        sam, text = L.SuffixAutomaton(seqs), [rng.randint(1, 4) for _ in range(40)]
        for i, (state, length) in enumerate(sam.statistics(text), 1):
            want = max(k for k in range(i + 1) if k == 0 or tuple(text[i - k:i]) in subs)
            assert length == want
            got = {(k, e) for k, e in sam.ends[state] if length}
            assert not length or got == {(k, e) for k, s in enumerate(seqs) for e in range(length, len(s) + 1) if s[e - length:e] == text[i - length:i]}


def test_templates_are_chained_over_edits(docs):
    name, text = L.TEMPLATES[0]
    ws = text.split()
    edited = ws[:12] + ["zzz"] + ws[13:30] + ["inserted", "words"] + ws[30:]
    rows = {1: "intro " + text.upper() + " outro", 2: " ".join(edited), 3: " ".join(ws[:6]), 4: " ".join(reversed(ws))}
    got = {r["doc_id"]: r for r in L.scan(docs(list(rows.items()))).collect()}
    assert got[1]["labels"] == name and got[1]["score"] == 1.0 and (got[1]["spans"][0]["first"], got[1]["spans"][0]["end"]) == (1, 1 + len(ws))
    assert got[2]["labels"] == name and 0.8 < got[2]["score"] < 1
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.3
    assert got[4]["labels"] == ""


def test_near_identical_notices_get_their_own_labels(docs):
    notice = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free "
              "Software Foundation; either version {} of the License, or (at your option) any later version.")
    rows = {"gpl-2.0": notice.format("program", "", "2"), "gpl-3.0": notice.format("program", "", "3"), "lgpl-2.1": notice.format("library", "Lesser ", "2.1"),
            "lgpl-3.0": notice.format("library", "Lesser ", "3"), "agpl-3.0": notice.format("program", "Affero ", "3"),
            "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
            "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                   "copyright notice and this permission notice appear in all copies.",
            "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                         "distribute this software",
            "mit-text": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."}
    names = list(rows)
    got = {names[r["doc_id"]]: set(r["labels"].split(",")) - {"gpl"} for r in L.scan(docs([(i, rows[n]) for i, n in enumerate(names)])).collect()}
    assert got == {n: {n} for n in names}
    version_2 = notice.replace(" as published", " version 2 as published").replace("; either version {} of the License, or (at your option) any later version", "").format("program", "")
    assert L.scanner().scan(version_2.encode())[5] == "gpl,gpl-2.0"


def test_many_notices_in_one_text_are_found_like_one():
    notice = max((t for t, _ in L.TEMPLATES), key=len) + " "
    between = " ".join(f"zebra{i}" for i in range(L.MAX_GAP + 5)) + " "
    scanner = L.scanner()
    one = scanner.scan((notice + between).encode())
    n = 150
    many = scanner.scan(((notice + between) * n).encode())
    assert one[7] and many[0] == n * one[0] and many[1] == n * one[1] and many[5] == one[5] and many[6] == one[6]
    assert many[7] == sorted((s[0], s[1] + i * one[0], s[2] + i * one[0], s[3]) for s in one[7] for i in range(n))


def test_results_do_not_depend_on_the_block_size(monkeypatch):
    rng = random.Random(9)
    parts = [t for t, _ in L.TEMPLATES] + ["some words of our own that no licence holds"]
    texts = [" ".join(rng.choice(parts) for _ in range(12)).encode() for _ in range(6)]
    found = {}
    for block in (1, 7, 256, 10**9):
        monkeypatch.setattr(L, "BLOCK", block)
        found[block] = [L.scanner().scan(t) for t in texts]
    assert all(v == found[10**9] for v in found.values())
