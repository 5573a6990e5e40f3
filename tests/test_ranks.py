"""Ranks and running totals: null groups and scores, ties, and how the rows are dealt."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lossloom.functions.ranks import class_sums, exact_quantiles, global_rank, in_ranges, rank_decile, running_totals


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_totals_with_null_groups_and_scores(spark, no_broadcast):
    rng = random.Random(4)
    cells = {(g, s): rng.randint(1, 9) for g in ("a", "b", None) for s in (None, *range(200))}
    df = spark.createDataFrame([(g, s, n) for (g, s), n in cells.items()], "g string, s long, n long")
    out = running_totals(df, ["g"], ["s"], ["n"]).collect()
    assert len(out) == len(cells)
    for r in out:
        same = {s: n for (g, s), n in cells.items() if g == r["g"]}
        low = -1 if r["s"] is None else r["s"]
        assert r["n_all"] == sum(same.values()) and r["n_cum"] == sum(n for s, n in same.items() if (-1 if s is None else s) <= low)


def test_ranges_are_found_by_halving(spark):
    values = [None, *[i * i % 997 / 4 for i in range(600)], float("nan")]
    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in values] + [("empty", None)], "g string, v double")
    for n in (2, 3, 64, 500):
        placed, small = in_ranges(df, ["g"], "v", n)
        plan = placed._jdf.queryExecution().optimizedPlan().toString()
        assert small and "filter(_cuts" not in plan  # a row is not compared with every cut
        cuts = {r["g"]: r["c"] for r in df.groupBy("g").agg(F.percentile_approx("v", [i / n for i in range(1, n)], 32 * n).alias("c")).collect()}
        for r in placed.collect():
            v = r["v"]
            above = [c for c in cuts[r["g"]] or () if v is not None and (c < v or (math.isnan(v) and not math.isnan(c)))]
            assert r["_range"] == len(above)


def test_a_tie_held_by_most_rows_is_spread(spark, no_broadcast):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("k"), F.lit("only").alias("g"), F.when(F.col("id") % 10 < 9, 0.5).otherwise(F.col("id") / n).alias("s"))
    ranked = global_rank(df, ["g"], "s", ["k"])
    per_task = [r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == n and max(per_task) < n / 4
    rows = ranked.collect()
    assert sorted(r["rn"] for r in rows) == list(range(1, n + 1)) and {r["n"] for r in rows} == {n}
    assert [r["s"] for r in sorted(rows, key=lambda r: r["rn"])] == sorted(r["s"] for r in rows)


def test_quantiles_match_linear_interpolation(spark, no_broadcast):
    values = [random.Random(i).random() for i in range(101)]
    df = spark.createDataFrame([("x", v) for v in values] + [("y", 1.0), ("x", None)], "g string, v double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "v", [0.05, 0.5, 0.95]).collect()}
    s = sorted(values)
    assert got["x"] == pytest.approx([s[5], s[50], s[95]]) and got["y"] == [1.0, 1.0, 1.0]


@pytest.mark.parametrize("shape", ["spread", "tied", "few"])
def test_class_sums_match_ranked_rows(spark, shape):
    """Every class as if all rows were ranked, with values spread, mostly tied, or fewer rows than classes; groups may be null."""
    rng = random.Random(6)
    n = 7 if shape == "few" else 1500
    rows = [(i, rng.choice(["a", "b", None]), round(rng.random(), 3) if shape != "tied" or i % 3 else 0.4, rng.choice([1.0, 2.5])) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, g string, s double, w double")
    got = class_sums(df, ["g"], "s", ["k"], {"w": F.col("w"), "ws": F.col("w") * F.col("s")}, {"lo": F.col("k")}, {"hi": F.col("s")}).collect()
    ranked = global_rank(df, ["g"], "s", ["k"]).withColumn("class", rank_decile()).groupBy("g", "class")
    want = ranked.agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("s")).alias("ws"), F.min("k").alias("lo"), F.max("s").alias("hi")).collect()
    key = lambda r: (str(r["g"]), r["class"])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (a["g"], a["class"], a["rows"], a["lo"], a["hi"]) == (b["g"], b["class"], b["rows"], b["lo"], b["hi"])
        assert a["w"] == pytest.approx(b["w"]) and a["ws"] == pytest.approx(b["ws"])


def test_class_sums_send_on_only_what_an_edge_crosses(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("k"), F.lit("g").alias("g"), (F.col("id") * 7919 % n / n).alias("s"))
    sent = []
    from lossloom.functions import ranks as R

    real = R.global_rank
    try:
        R.global_rank = lambda rows, *a: (sent.append(rows.count()), real(rows, *a))[1]
        out = class_sums(df, ["g"], "s", ["k"], {"w": F.lit(1.0)}).collect()
    finally:
        R.global_rank = real
    assert sorted(r["rows"] for r in out) == [2000] * 10 and sent[0] <= n * 9 / 16 * 1.2
