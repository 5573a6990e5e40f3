"""BPE encoding and decoding through a pair occurrence index.

The distinct pre-tokens that a partition has not met before form one linked sequence of symbols. An index maps the rank of every
adjacent pair to all its positions. Active ranks are applied in ascending order; each merge rewrites all positions of
its pair at once and files the pairs it creates under their ranks. A merge can only create pairs of a higher rank,
because the vocabulary has one merge per token, so each rank is visited once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Distinct pre-tokens a worker remembers before it starts afresh; only speed depends on it.
REMEMBERED = 500_000
#: Texts handed on together to the index, in characters.
CHUNK_CHARS = 6 << 20

# Fixed values of the vocabulary files: the split pattern, its white space, the end-of-word mark. Letters come first here:
# no other alternative can begin with one. White space only separates, so the normalizer's folding of it changes nothing.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
SPLIT = rf"[\p{{L}}]+|[\p{{N}}]|'s|'t|'re|'ve|'m|'ll|'d|[^{WHITE}\p{{L}}\p{{N}}]+"
#: The same for lower-cased text of ASCII and Latin-1 letters alone, where the standard module is faster.
LATIN = "a-z\xdf-\xf6\xf8-\xff"
LATIN_SPLIT = rf"[{LATIN}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^{WHITE}{LATIN}0-9]+"
NOT_LATIN = rf"[^\x00-\x7f{LATIN}]"
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable Latin-1, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder of one vocabulary file with word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max(*vocab.values(), *self.special.values()) + 1)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = len(self.tokens)
        keys = self.left * self.width + self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.split = regex.compile(SPLIT)
        self.latin_split, self.not_latin = re.compile(LATIN_SPLIT), re.compile(NOT_LATIN)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """Words in order; special tokens stand as themselves. Lower-casing goes letter by letter, without context."""
        out: list[str] = []
        for part in self.marks.split(text) if self.marks and "<|" in text else (text,):
            if part in self.special:
                out.append(part)
            elif part:
                plain = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()
                out += (self.split if self.not_latin.search(plain) else self.latin_split).findall(plain)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge exists."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def learn(self, words: list[str]) -> None:
        """Encode words not met before, all in one index."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        sym = self.inner[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(pos: np.ndarray) -> None:
            ranks = self._ranks(sym[pos], sym[after[pos]])
            pos, ranks = pos[ranks >= 0], ranks[ranks >= 0]
            if not len(pos):
                return
            order = np.argsort(ranks, kind="stable")
            pos, ranks = pos[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, where in zip(ranks[np.r_[0, cuts]].tolist(), np.split(pos, cuts), strict=True):
                if rank in index:
                    index[rank].append(where)
                else:
                    index[rank] = [where]
                    heapq.heappush(heap, rank)

        file(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            pos = np.unique(pos)
            a, b = self.left[rank], self.right[rank]
            nxt = after[pos]
            good = (sym[pos] == a) & (nxt >= 0)
            good[good] = sym[nxt[good]] == b
            pos, nxt = pos[good], nxt[good]
            if a == b and len(pos) > 1:
                take, used = [], -1
                for k, (p, q) in enumerate(zip(pos.tolist(), nxt.tolist(), strict=True)):
                    if p != used:
                        take.append(k)
                        used = q
                pos, nxt = pos[take], nxt[take]
            if not len(pos):
                continue
            sym[pos] = self.merged[rank]
            sym[nxt] = -1
            beyond = after[nxt]
            after[pos] = beyond
            has = beyond >= 0
            before[beyond[has]] = pos[has]
            prior = before[pos]
            file(np.concatenate([prior[prior >= 0], pos[has]]))
        alive = sym >= 0
        ids = sym[alive].astype("<u4").tobytes()
        upto = np.r_[0, np.cumsum(alive)[ends - 1]] * 4
        self.known.update(zip(words, [ids[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars < CHUNK_CHARS):
                chars += len(texts[hi])
                hi += 1
            words = [self.pre_tokens(t) for t in texts[lo:hi]]
            if len(self.known) > REMEMBERED:
                self.known = {}
            for mark, i in self.special.items():
                self.known[mark] = int(i).to_bytes(4, "little")
            fresh = set().union(*words).difference(self.known)
            if fresh:
                self.learn(list(fresh))
            out += [b"".join(map(self.known.__getitem__, w)) for w in words]
            lo = hi
        return out

    def decode(self, ids: bytes) -> str:
        """Token texts separated by single spaces, special tokens included (the files name no decoder)."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def _mapped(docs: DataFrame, id_col: str, schema: T.StructType, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 4000
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                yield row(part.column(0), [t or "" for t in part.column(1).to_pylist()])

    return docs.select(id_col, "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id, n_tokens and ids (binary, little-endian unsigned 32-bit). A null text is empty, with no ids."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def row(keys, texts):
        ids = coder(path).encode(texts)
        return pa.RecordBatch.from_arrays([keys, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                                          [id_col, "n_tokens", "ids"])

    return _mapped(docs, id_col, schema, row)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id, n_tokens, ids_sha256 and decoded_sha256, the digests of the ids and of the text decoded from them.

    Null texts are empty; repeated rows answer alike; other columns are not read. Empty in, empty out.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    def row(keys, texts):
        bpe = coder(path)
        ids = bpe.encode(texts)
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
             pa.array([hashlib.sha256(bpe.decode(i).encode("utf-8")).hexdigest() for i in ids], pa.string())],
            [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, id_col, schema, row)
