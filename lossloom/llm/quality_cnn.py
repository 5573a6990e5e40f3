"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes, one weight per place and byte, slide over the whole document one byte at a time. The
positions are cut into chunks of ``CHUNK``; windows reach over the edge of their chunk into the next one, so nothing falls between chunks.
Each filter is max-pooled per chunk; a document is described by the mean and the maximum of its chunks and scored by
one logistic unit. The gradient of a max-pooled filter touches one window per chunk, which keeps training cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossloom.llm.common import crc_mod, hash_of, slices, smallest_hashes

FILTERS, WIDTH, CHUNK = 24, 8, 512
#: Labelled rows per class that a fit uses at most, those with the smallest hash of the id: the bound of the training sample.
SAMPLE_PER_CLASS = 1500
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.01, 1e-5
THRESHOLD = 0.3


class ByteCNN:
    def __init__(self, seed: int = 7, filters: int = FILTERS, width: int = WIDTH, chunk: int = CHUNK):
        rng = np.random.default_rng(seed)
        self.chunk = chunk
        self.w = rng.normal(0, 0.3 / np.sqrt(width), (width, 256, filters)).astype(np.float32)
        self.b = np.zeros(filters, np.float32)
        self.v = rng.normal(0, 0.1, 2 * filters).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def _activations(self, codes: np.ndarray) -> np.ndarray:
        """Filter responses at every byte; beyond the end the text is padded with zero bytes."""
        width, n = len(self.w), len(codes)
        padded = np.concatenate([codes, np.zeros(width - 1, np.uint8)])
        a = self.w[0][padded[:n]]
        for j in range(1, width):
            a += self.w[j][padded[j:j + n]]
        return a

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter per chunk (chunks x filters) and the byte it was found at."""
        a = self._activations(codes)
        starts = range(0, len(codes), self.chunk)
        at = np.stack([s + a[s:s + self.chunk].argmax(0) for s in starts])
        return a[at, np.arange(a.shape[1])], at

    def score(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text of a slice. An empty text is scored from the bias alone."""
        codes = np.frombuffer(raw, np.uint8)
        width, n_docs = len(self.w), len(offsets) - 1
        features = np.zeros((n_docs, len(self.v)), np.float32)
        sizes = np.diff(offsets)
        k = self.w.shape[2]
        # Long texts go in pieces of whole chunks, short ones one by one: the working set stays in the cache.
        piece = 64 * self.chunk
        for d in np.flatnonzero(sizes).tolist():
            text = codes[offsets[d]:offsets[d + 1]]
            total, top, chunks = np.zeros(k, np.float32), np.zeros(k, np.float32), 0
            for lo in range(0, len(text), piece):
                a = self._activations(text[lo:lo + piece + width - 1])[:piece]
                m = np.maximum(np.maximum.reduceat(a, np.arange(0, len(a), self.chunk), axis=0) + self.b, 0)
                total += m.sum(0)
                top = np.maximum(top, m.max(0))
                chunks += len(m)
            features[d, :k], features[d, k:] = total / chunks, top
        z = features @ self.v + self.c
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> ByteCNN:
        """Adam on the logistic loss, classes weighted equally; deterministic for given rows in given order."""
        rng = np.random.default_rng(seed)
        y = labels.astype(np.float32)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        params = [self.w, self.b, self.v, self.c]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        k, step = self.w.shape[2], 0
        cols = np.arange(k)
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                grads = [np.zeros_like(p) for p in params]
                rows = order[lo:lo + BATCH]
                for i in rows.tolist():
                    codes = np.frombuffer(texts[i], np.uint8)
                    if not len(codes):
                        continue
                    peak, at = self.pooled(codes)
                    h = np.maximum(peak + self.b, 0)
                    n = len(h)
                    best = h.argmax(0)
                    feats = np.concatenate([h.mean(0), h[best, cols]])
                    z = float(feats @ self.v + self.c[0])
                    g = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(rows))
                    grads[2] += g * feats
                    grads[3] += g
                    gh = np.repeat(self.v[None, :k] * g / n, n, axis=0)
                    gh[best, cols] += self.v[k:] * g
                    gh *= h > 0
                    grads[1] += gh.sum(0)
                    padded = np.concatenate([codes, np.zeros(len(self.w) - 1, np.uint8)])
                    for j in range(len(self.w)):
                        np.add.at(grads[0][j], (padded[at + j], np.broadcast_to(cols, at.shape)), gh)
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, gr, a, b in zip(params, grads, m1, m2, strict=True):
                    a *= 0.9
                    a += 0.1 * gr
                    b *= 0.999
                    b += 0.001 * gr * gr
                    p -= (lr * a / (np.sqrt(b) + 1e-8) + DECAY * p).astype(np.float32)
        return self


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 5) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", per_class: int = SAMPLE_PER_CLASS, epochs: int = EPOCHS) -> ByteCNN:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fold, chosen by a hash of the id.

    Rows with a null id or label never train. Without rows of both classes the untrained network is returned with a
    score of the only class's side, or 0.5 without any.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    ids = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").cast("int").alias("_y"))
    one = [smallest_hashes(ids.where(F.col("_y") == y), "_id", "cnn", per_class) for y in (0, 1)]
    picked = one[0].unionByName(one[1])  # at most 2 * per_class rows, which bounds the broadcast and what is collected
    rows = (docs.select(F.col(id_col), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col(id_col) == F.col("_id"))
            .groupBy("_id").agg(F.max("text").alias("text"), F.max("_y").alias("_y")).orderBy(hash_of("_id", "cnn")).collect())
    net = ByteCNN()
    y = np.array([r["_y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        net.v[:] = 0
        net.c[:] = 0 if not len(y) else (3 if y[0] else -3)
        return net
    return net.fit([r["text"].encode("utf-8") for r in rows], y, epochs=epochs)


def score(docs: DataFrame, net: ByteCNN, id_col: str = "doc_id", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id (and the columns in ``keep``), held_out, score and predicted for every input row and its whole text.

    A null text is empty; repeated rows answer alike; a null id is not held out. Only the text goes into the score.
    Empty in, empty out.
    """
    kept = [c for c in keep if c != id_col]
    src = docs.select(id_col, *kept, held_out(id_col).alias("_held"), F.col("text").alias("_text"))
    schema = T.StructType([docs.schema[id_col], *[docs.schema[c] for c in kept], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.concatenate([net.score(raw, offsets) for _, _, raw, offsets in slices(batch, "_text")])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept) + 2], pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema.names)

    return src.mapInArrow(run, schema)
