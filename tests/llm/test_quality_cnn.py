from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import types as T

from llm_cases import EDGE
from lossloom.llm import quality_cnn as Q

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def made(n):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        ws = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(ws) + "." if i % 3 else " ".join(w.upper() + "!!" for w in ws)))
    return rows


def test_held_out_accuracy_and_whole_texts(spark, docs):
    rows = made(240)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows] + [(None, 1, 0), (3, None, None), (9999, 1, 0)], LABELS)
    net = Q.train(docs(rows), labels, epochs=6)
    out = Q.score(docs(rows), net).collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= Q.THRESHOLD)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held]) > 0.95
    # Junk far behind the first chunks still counts.
    tail = rows[1][1] * 60 + " " + rows[0][1] * 60
    a, b = (r["score"] for r in sorted(Q.score(docs([(1, rows[1][1] * 120), (2, tail)]), net).collect()))
    assert b < a
    edge = Q.score(docs(EDGE), net).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    assert Q.score(docs([]), net).collect() == []


def test_held_out_labels_and_other_columns_never_matter(spark, docs):
    rows = made(60)
    flip = [(i, int(i % 3 != 0) ^ (zlib.crc32(str(i).encode()) % 5 == 0), 0) for i, _ in rows]
    a = Q.train(docs(rows), spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows], LABELS), epochs=1)
    b = Q.train(docs(rows), spark.createDataFrame(flip, LABELS), epochs=1)
    assert all(np.array_equal(x, y) for x, y in ((a.w, b.w), (a.v, b.v), (a.b, b.b)))


def test_without_labels_or_with_one_class(spark, docs):
    for y, want in ((None, 0.5), (1, 0.95), (0, 0.05)):
        labels = spark.createDataFrame([] if y is None else [(i, y, 0) for i in range(20)], LABELS)
        (r,) = Q.score(docs([(1, "a")]), Q.train(docs(made(20)), labels)).collect()
        assert abs(r["score"] - want) < 0.01


def test_chunked_scoring_equals_one_pass():
    net = Q.ByteCNN(seed=2)
    rng = np.random.default_rng(1)
    for n in (1, 5, 511, 512, 513, 40_000, 70_001):
        codes = rng.integers(0, 256, n, dtype=np.uint8)
        peak, _ = net.pooled(codes)
        h = np.maximum(peak + net.b, 0)
        want = 1 / (1 + np.exp(-float(np.concatenate([h.mean(0), h.max(0)]) @ net.v + net.c[0])))
        assert abs(net.score(codes.tobytes(), np.array([0, n]))[0] - want) < 1e-5
