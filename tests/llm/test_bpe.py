from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm_cases import EDGE
from lossloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_matches_the_library(corpus):
    rng = random.Random(11)
    pool = list("abcAB'sT12 _-!?\n\t") + ["\x1c", "\x85", " ", "Σ", "İ", "é", "é", "ß", "١", "Ⅷ", "😀", "中", "<|endoftext|>", "<|startoftext|>", "<|"]
    texts = ["", "aaaa aaaaa aaaaaaa", "x" * 3000, *["".join(rng.choice(pool) for _ in range(rng.randint(1, 50))) for _ in range(400)],
             *[r[1] or "" for r in corpus]]
    lib, own = library(), bpe.PairIndexBPE(PATH)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = [" ".join(f"word{i * j % 37}" for j in range(30)) for i in range(50)]
    want = bpe.PairIndexBPE(PATH).encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    assert bpe.PairIndexBPE(PATH).encode(texts) == want


def test_round_trip_rows(docs):
    lib = library()
    out = bpe.round_trip(docs(EDGE), PATH).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = []
    for k, text in EDGE:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert bpe.round_trip(docs([]), PATH).collect() == [] and bpe.encode(docs([]), PATH).collect() == []
