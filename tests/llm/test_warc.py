from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from lossloom.llm import warc as W
from lossloom.llm.common import importable

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def expected(rows):
    first = {}
    for k, _, h in rows:
        b = (h or "").encode()
        if k is not None and len(b) >= W.LEAST_REVISIT:
            first[b] = min(first.get(b, k), k)
    out = Counter()
    for k, _, h in rows:
        b = (h or "").encode()
        f = first.get(b, k)
        out[k, len(b), hashlib.sha256(b).hexdigest(), "response" if f == k else "revisit", None if f == k else f] += 1
    return out


def test_pages_come_back(spark):
    importable(spark)
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}\r\nX: y", "".join(rng.choice("<p>é中\r\n𝔘 ") for _ in range(rng.choice([0, 5, 99, 100, 3000, 60_000])))) for i in range(60)]
    rows += [(100 + i, None, "same " * 40) for i in range(30)] + [(None, "u", "same " * 40), (None, "u", "alone " * 40), (5, "u", None), (200, "u", ""), (201, "u", "x" * 500_000)]
    rows += [(300, "u", "short"), (301, "u", "short"), (302, "v", "twice " * 30), (302, "v", "twice " * 30), (303, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 50)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, W.archive_and_read(pages).collect())) == expected(rows)
    assert W.archive_and_read(pages.limit(0)).collect() == []


def parts(payload, segment):
    got = []
    for r in W.records(1, "http://x", payload, hashlib.sha256(payload).hexdigest(), None, 7, segment):
        ((headers, block),) = W.parse(r + W.END)
        got.append(W._part(headers, block))
    return got


def test_segments_are_checked():
    payload = bytes(range(256)) * 40
    good = parts(payload, 1000)
    assert len(good) > 5 and W.reassembled(good)[6] == hashlib.sha256(payload).hexdigest()
    for broken in (good[:-1], good[1:], good[:2] + good[3:], good[:2] + good[1:]):
        with pytest.raises(ValueError):
            W.reassembled(broken)


def test_framing_round_trips_and_rejects():
    for body in (b"", b"x", b"\r\n0\r\n\r\n" * 2000):
        assert W.dechunked(W.chunked(body, 7)) == body
    assert W.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            W.dechunked(bad)
    record = next(W.records(1, "u", b"abc", "d", None, 0)) + W.END
    gz = lambda b: (c := zlib.compressobj(wbits=31)).compress(b) + c.flush()
    assert len(list(W.parse(gz(record) + gz(record)))) == 2
    with pytest.raises(ValueError):
        list(W.parse(record[:-6]))
