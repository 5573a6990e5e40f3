"""Interpolated modified Kneser-Ney bigram model, counted in Spark and stored as sorted hash arrays.

Training: tasks tokenise with numpy and reduce their words and word pairs to sorted arrays; Spark deals those by hash
range and the reducers merge them and write one array file per range to the shared folder. A pair's key is an
invertible hash of two 32-bit word ids, so the pairs of a frequent word are spread over all ranges and still exact.
Context and continuation statistics are partial sums of the ranges, merged per id range. Scoring: every worker maps the
files into memory and looks tokens up by binary search. Nothing of the model passes through the driver but its file
count, sums and discounts.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lossloom.llm.common import crc_mod, slices
from lossloom.llm.wordhash import LOWER, mix, word_hashes
from lossloom.sources.store import shared_root

#: Hash of the end of a text, which counts as a token; a text's first token has the context BOS.
END = np.uint64(0x7E57E57E57E57E57)
#: Token events that one range or one task's buffer holds on average.
PER_RANGE = 1 << 20
BUFFERED = 1 << 22
BLOB = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("data", T.BinaryType())])
BLOB_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _tokens(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with an END after each text, n+1 offsets of the texts' tokens)."""
    for lo, hi, raw, offsets in slices(batch, column):
        words, at = word_hashes(raw.translate(LOWER), offsets)
        n = np.arange(hi - lo + 1)
        tokens = np.empty(len(words) + hi - lo, np.uint64)
        ends = at[1:] + n[:-1]
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = words
        tokens[ends] = END
        yield lo, hi, tokens, at + n


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes: one each, those over 254 as 255 with the full numbers behind."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return low.tobytes() + counts[low == 255].astype("<u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(data[:n], np.uint8)
    counts = low.astype(np.uint64)
    counts[low == 255] = np.frombuffer(data[n:], "<u8")
    return counts


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def _dealt(keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Sorted keys cut into equal ranges of the hash space, one blob (n, keys, counts) per range."""
    cut = np.searchsorted(keys, _bounds(parts))
    cut = np.r_[cut, len(keys)]
    rows = [(p, np.uint64(j - i).tobytes() + keys[i:j].tobytes() + _small(counts[i:j]))
            for p, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if j > i]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()),
                                       pa.array([d for _, d in rows], pa.binary())], schema=BLOB_ARROW)


def _bounds(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(parts)], np.uint64)


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for b in blobs:
        n = int(np.frombuffer(b[:8], np.uint64)[0])
        keys.append(np.frombuffer(b[8:8 + 8 * n], np.uint64))
        counts.append(_wide(b[8 + 8 * n:], n))
    return _counted(np.concatenate(keys), np.concatenate(counts))


# The finalizer of ``mix`` and its inverse: a bijection of 64-bit numbers.
def unmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _local(uri: str) -> str:
    """The mounted path of the shared folder. Memory mapping needs one that every machine mounts."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"the model is mapped from mounted files; spark.checkpoint.dir names {u.scheme}:")
    return unquote(u.path) if u.scheme else uri


def _save(path: str, **arrays: np.ndarray) -> None:
    """One file per array. A repeated task replaces whole files with the same content."""
    for name, a in arrays.items():
        temp = f"{path}-{name}.{uuid.uuid4().hex}.tmp"
        with open(temp, "wb") as f:
            np.save(f, a)
        os.replace(temp, f"{path}-{name}.npy")


def _grouped(blobs: DataFrame, reduce: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Blobs of one part meet in one task, in kind order; a part holds a bounded share of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                rows = list(reduce(part, held))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(BLOB_ARROW)], schema=BLOB_ARROW)

        for batch in batches:
            for p, k, d in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != part:
                    yield from emit()
                    part, held = p, []
                held.append((k, d))
        yield from emit()

    return blobs.repartition("part").sortWithinPartitions("part").mapInArrow(run, BLOB)


class Model:
    """A stored model, mapped into memory: lookups by binary search in sorted arrays."""

    def __init__(self, folder: str):
        self.folder = folder
        with open(f"{folder}/meta.json") as f:
            meta = json.load(f)
        self.parts, self.offsets, self.n_tokens, self.n_vocab = meta["parts"], np.array(meta["offsets"], np.int64), meta["n_tokens"], meta["n_vocab"]
        self.pair_discounts, self.word_discounts = np.array(meta.get("pair_discounts", [0] * 4)), np.array(meta.get("word_discounts", [0] * 4))
        self.continuations, self.rest = meta.get("continuations", 0), meta.get("rest", 1.0)
        self.bounds = _bounds(self.parts)
        self.files: dict[str, np.ndarray] = {}

    def _map(self, kind: str, part: int, name: str) -> np.ndarray | None:
        path = f"{self.folder}/{kind}-{part}-{name}.npy"
        if path not in self.files:
            self.files[path] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.files[path]

    def _find(self, kind: str, keys: np.ndarray, visit: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None]) -> None:
        """For sorted keys call visit(part, positions in keys, places found, hit or not)."""
        cut = np.r_[np.searchsorted(keys, self.bounds), len(keys)]
        for p in np.flatnonzero(np.diff(cut)).tolist():
            stored = self._map(kind, p, "keys")
            if stored is None:
                continue
            want = keys[cut[p]:cut[p + 1]]
            at = np.minimum(np.searchsorted(stored, want), len(stored) - 1)
            visit(p, np.arange(cut[p], cut[p + 1]), at, stored[at] == want)

    def words(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each token hash; -1 and 0 for a word that training never met."""
        keys, back = np.unique(tokens, return_inverse=True)
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)

        def visit(p, pos, at, hit):
            ids[pos[hit]] = self.offsets[p] + at[hit]
            counts[pos[hit]] = self._map("words", p, "counts")[at[hit]]

        self._find("words", keys, visit)
        return ids[back], counts[back]

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        uniq, back = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(uniq), np.int64)

        def visit(p, pos, at, hit):
            low = self._map("pairs", p, "counts")[at[hit]].astype(np.int64)
            big = low == 255
            if big.any():
                where, full = self._map("pairs", p, "big_at"), self._map("pairs", p, "big")
                low[big] = full[np.searchsorted(where, at[hit][big])]
            counts[pos[hit]] = low

        self._find("pairs", uniq, visit)
        return counts[back]

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """(total, n1, n2, n3 of the id as a context, continuation count) per id; zeros for -1."""
        uniq, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(uniq), 5), np.int64)
        cut = np.r_[np.searchsorted(uniq, self.offsets), len(uniq)]
        cut[0] = np.searchsorted(uniq, 0)
        for p in np.flatnonzero(np.diff(cut) > 0).tolist():
            table = self._map("stats", p, "table")
            if table is not None:
                out[cut[p]:cut[p + 1]] = table[uniq[cut[p]:cut[p + 1]] - self.offsets[p]]
        return out[back]

    def log10(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of each word id after its context id (-1: unknown; BOS: the vocabulary size)."""
        known = (ids >= 0) & (before >= 0)
        both = np.zeros(len(ids), np.int64)
        both[known] = self.pairs(pair_keys(before[known], ids[known]))
        word, ctx = self.stats(ids), self.stats(before)
        p = np.maximum(word[:, 4] - self.word_discounts[np.minimum(word[:, 4], 3)], 0) / max(self.continuations, 1) + self.rest / (self.n_vocab + 1)
        total = ctx[:, 0]
        d = self.pair_discounts
        spare = ctx[:, 1] * d[1] + ctx[:, 2] * d[2] + ctx[:, 3] * d[3]
        top = np.maximum(both - d[np.minimum(both, 3)], 0)
        return np.log10(np.where(total > 0, (top + spare * p) / np.maximum(total, 1), p))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))


def discounts(n: list[int]) -> list[float]:
    """(0, D1, D2, D3+) from the numbers of n-grams seen once to four times; where those say nothing, a half of the count at most."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0, *[min(max(d, 0.05), k) for k, d in zip((0.95, 1.9, 2.85), raw, strict=True)]]


@lru_cache(maxsize=1)
def model(folder: str, complete: bool = True) -> Model:
    """The model as a worker has mapped it; during training only the words are there."""
    return Model(folder)


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(counts == k) for k in (1, 2, 3, 4)], np.int64)


def train(docs: DataFrame) -> str:
    """Fit on the column ``text`` (null: empty) of every row and return the folder of the model. An empty table gives an empty model."""
    spark = docs.sparkSession
    folder = f"{_local(shared_root(spark))}/lossloom/{spark.sparkContext.applicationId}/kneser-ney-{uuid.uuid4().hex[:12]}"
    os.makedirs(folder)
    texts = docs.select("text")
    parts = max(8, -(-docs.count() // 4000))  # of words; the pairs get their parts from the token count

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _buffered((t for b in batches for _, _, t, _ in _tokens(b, "text")), parts)

    def merge_words(part: int, held: list) -> Iterator[tuple[int, int, bytes]]:
        keys, counts = _merged([d for _, d in held])
        _save(f"{folder}/words-{part}", keys=keys, counts=counts)
        yield part, 0, _pack(np.array([len(keys), counts.sum()], np.uint64))

    sizes = {r["part"]: np.frombuffer(r["data"], np.uint64) for r in _grouped(texts.mapInArrow(words, BLOB), merge_words).collect()}
    per_part = [int(sizes[p][0]) if p in sizes else 0 for p in range(parts)]
    n_tokens, n_vocab = sum(int(s[1]) for s in sizes.values()), sum(per_part)
    if n_vocab >= 1 << 32:
        raise ValueError("word ids exceed 32 bits")
    meta = {"parts": parts, "offsets": [0, *np.cumsum(per_part)[:-1].tolist()], "n_tokens": n_tokens, "n_vocab": n_vocab}
    _write_meta(folder, meta)
    if not n_tokens:
        return folder
    offsets = np.array(meta["offsets"], np.int64)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(folder, complete=False)
        yield from _buffered((pair_keys(_contexts(ids, at, n_vocab), ids) for b in batches for ids, at in
                              ((m.words(t)[0], at) for _, _, t, at in _tokens(b, "text"))), parts)

    def merge_pairs(part: int, held: list) -> Iterator[tuple[int, int, bytes]]:
        keys, counts = _merged([d for _, d in held])
        low = np.minimum(counts, 255).astype(np.uint8)
        big = np.flatnonzero(low == 255)
        _save(f"{folder}/pairs-{part}", keys=keys, counts=low, big_at=big, big=counts[big].astype(np.int64), n=_counts_of_counts(counts))
        packed = unmix(keys)
        word = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        before = (packed >> np.uint64(32)).astype(np.int64)
        order = np.argsort(before, kind="stable")
        before, counts = before[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        table = np.stack([np.add.reduceat(x, first) for x in (counts, counts == 1, counts == 2, counts >= 3)], 1).astype("<u4")
        yield from _by_id(before[first], table, offsets, 0)
        yield from _by_id(*(x.astype(t) for x, t in zip(np.unique(word, return_counts=True), (np.int64, "<u4"), strict=True)), offsets, 1)

    def merge_stats(part: int, held: list) -> Iterator[tuple[int, int, bytes]]:
        # The last range also holds BOS, whose id follows the vocabulary.
        size = (per_part[part] if part < parts else 0) + (1 if part == parts - 1 else 0)
        table = np.zeros((size, 5), np.int64)
        for kind, data in held:
            n = int(np.frombuffer(data[:8], np.uint64)[0])
            ids, width = np.frombuffer(data[8:8 + 4 * n], "<u4").astype(np.int64), 1 if kind else 4
            values = np.frombuffer(data[8 + 4 * n:], "<u4").reshape(n, width).astype(np.int64)
            table[ids, 4:5] += values if kind else 0
            if not kind:
                table[ids, :4] += values
        _save(f"{folder}/stats-{part}", table=table.astype(np.int64), n=np.r_[table[:, 4].sum(), np.count_nonzero(table[:, 4] >= 3), _counts_of_counts(table[:, 4])])
        yield part, 0, b""

    stats = _grouped(_grouped(texts.mapInArrow(pairs, BLOB), merge_pairs), merge_stats)
    stats.select("part").write.format("noop").mode("overwrite").save()
    pair_n = sum((np.load(f"{folder}/pairs-{p}-n.npy") for p in range(parts) if os.path.exists(f"{folder}/pairs-{p}-n.npy")), np.zeros(4, np.int64))
    word_n = sum((np.load(f"{folder}/stats-{p}-n.npy") for p in range(parts) if os.path.exists(f"{folder}/stats-{p}-n.npy")), np.zeros(6, np.int64))
    d = discounts(word_n[2:].tolist())
    rest = (d[1] * word_n[2] + d[2] * word_n[3] + d[3] * word_n[1]) / max(int(word_n[0]), 1)
    _write_meta(folder, meta | {"pair_discounts": discounts(pair_n.tolist()), "word_discounts": d, "continuations": int(word_n[0]), "rest": float(rest)})
    return folder


def _write_meta(folder: str, meta: dict) -> None:
    with open(f"{folder}/meta.tmp", "w") as f:
        json.dump(meta, f)
    os.replace(f"{folder}/meta.tmp", f"{folder}/meta.json")


def _by_id(ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorted ids with their values, cut at the id ranges; ids are sent relative to their range."""
    cut = np.searchsorted(ids, offsets)
    cut = np.r_[cut, len(ids)]
    # Of ranges that start at the same id (empty ones) only the last can hold it.
    for p, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if j > i:
            yield p, kind, np.uint64(j - i).tobytes() + (ids[i:j] - offsets[p]).astype("<u4").tobytes() + values[i:j].tobytes()


def _buffered(arrays: Iterator[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for a in arrays:
        held.append(a)
        size += len(a)
        if size >= BUFFERED:
            yield _dealt(*_counted(np.concatenate(held)), parts)
            held, size = [], 0
    if held:
        yield _dealt(*_counted(np.concatenate(held)), parts)


def _contexts(ids: np.ndarray, at: np.ndarray, bos: int) -> np.ndarray:
    """The id before each token; BOS for the first token of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[at[:-1]] = bos
    return before


def score(docs: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities of the text).

    Tokens are the lower-cased words and one end per text; a null text has the end alone. n_known counts tokens that
    training met. base_score uses add-half unigram counts, score the model; words never met share what the model leaves
    for them. Repeated rows answer alike. With an empty model base_score has V = N = 0 and score is log10 of 1 per token.
    """
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(folder)
        base_of = np.log10(m.n_tokens + 0.5 * (m.n_vocab + 1))
        for batch in batches:
            for lo, hi, tokens, at in _tokens(batch, "text"):
                ids, counts = m.words(tokens)
                base = np.log10(counts + 0.5) - base_of
                logp = m.log10(ids, _contexts(ids, at, m.n_vocab))
                first = at[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(np.add.reduceat((counts > 0).astype(np.int64), first)),
                     pa.array(np.full(hi - lo, m.n_tokens, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logp, first))],
                    schema.names)

    return docs.select(id_col, "text").mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 5) == 1
