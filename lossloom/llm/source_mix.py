"""Mixing sources to target token weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u)/w, u being drawn from a hash of its id and w its quality weight. A source whose
target exceeds its size contributes complete epochs first; the fraction left over is filled in key order until the
prefix sum of sizes comes nearest to the budget. The prefix sum runs over key cells: cell totals are accumulated per
source and the ordered window stays inside one cell, so a source with a third of all rows is spread over many tasks.
Cells are cut at even steps of the keys' distribution function, which follows from the weights: a key is exponential with
its document's weight, so the share of rows up to a key is the mean of 1 - exp(-weight * key) over all weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossloom.llm.common import join_sized, text_of
from lossloom.sources.store import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
ROWS_PER_CELL = 20_000
SEED = "mix-1"


def quality_weight(text: Column) -> Column:
    """1 for prose, falling by twice the share of ASCII punctuation to 0.1 at the least; 1 for an empty text."""
    n = F.length(text)
    junk = n - F.length(F.regexp_replace(text, PUNCTUATION, ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(2.0) * junk / F.greatest(n, F.lit(1)))


def uniform(column: str, seed: str = SEED) -> Column:
    """A number in (0, 1] from 52 bits of the md5 of seed and value; null has its own fixed number."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_src, source_size, _n) -> the same and target = least(cap * size, level * weight), level set so that the targets add
    up to ``share`` of all sizes. That is the fixed point of sharing by weight and resharing what exceeds a cap.

    Works on one row per source, in two windows over that small table. Sources go by code point, null last.
    """
    by_name = Window.orderBy(F.col("_src").isNull(), F.encode("_src", "utf-8"))
    k = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % k + 1)
    ranked = per_source.withColumn("_w", w).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    # In order of cap / weight: the level if exactly the sources before this one are at their caps. The first level that
    # leaves its own source below the cap is the fixed point.
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_src").isNull(), F.encode("_src", "utf-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    stated = ranked.withColumn("_rank", F.row_number().over(order)).withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct("_rank", "_level"))
    fixed = stated.withColumn("_level", F.min(fits).over(whole)["_level"])
    target = F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap"))
    return fixed.select("_src", "source_size", "_n", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def distribution(weights: DataFrame, key: Column) -> Column:
    """Share of rows with a key up to ``key``, from (_w) rows: weights are gathered in steps of 1/20, at most 21 of them."""
    levels = weights.groupBy(F.round(F.col("_w") * 20).alias("_l")).agg(F.avg("_w").alias("_m"), F.count(F.lit(1)).alias("_n")).orderBy("_l").collect()
    total = sum(r["_n"] for r in levels)
    out = F.lit(0.0)
    for r in levels:
        out = out + F.lit(r["_n"] / total) * (1 - F.exp(-F.lit(float(r["_m"])) * key))
    return out


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def decided(docs: DataFrame, id_col: str, seed: str, rows_per_cell: int) -> DataFrame:
    """One row per input row: the id, _s, size, source_size, target and times."""
    t = text_of()
    rows = docs.select(F.col(id_col), F.col("source").alias("_src"), size_of(t).alias("size"), quality_weight(t).alias("_w"))
    rows = rows.withColumn("_key", -F.log(uniform(id_col, seed)) / F.col("_w"))
    rows = cut_lineage(rows.withColumn("_s", source_key(F.col("_src"))), "mix-rows")
    totals = targets(rows.groupBy("_src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")))
    totals = totals.select(source_key(F.col("_src")).alias("_s"), "source_size", "target")
    cells = max(1, -(-rows.count() // rows_per_cell))
    placed = rows.withColumn("_cell", F.floor(distribution(rows, F.col("_key")) * cells))
    per_cell = placed.groupBy("_s", "_cell").agg(F.sum("size").alias("_sum"))
    run = Window.partitionBy("_s").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_cell.withColumn("_before", F.coalesce(F.sum("_sum").over(run), F.lit(0)))
               .join(totals, "_s").select("_s", "_cell", "_before", "source_size", "target"))
    inside = Window.partitionBy("_s", "_cell").orderBy("_key", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    run_up = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    left = F.col("target") - F.col("_epochs") * F.col("source_size")
    extra = (left > 0) & (F.col("_run") + F.col("size") / 2 <= left)
    return (placed.join(offsets, ["_s", "_cell"]).withColumn("_run", run_up).withColumn("_epochs", epochs)
            .select(id_col, "_s", "size", "source_size", "target", (F.col("_epochs") + extra.cast("int")).cast("long").alias("times")))


def sample(docs: DataFrame, id_col: str = "doc_id", seed: str = SEED, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """One row per input row: the id, size, source_size, target, times (copies the mix takes) and taken = times * size.

    Size counts the runs of other characters than space and tab to carriage return; a null text has none. A null source
    is a source of its own, the last. Rows equal in id share one key and are ordered by size. Documents without words
    follow the epochs of their source and never count. Reads id, text and source only. Empty in, empty out.
    """
    out = decided(docs, id_col, seed, rows_per_cell)
    return out.select(id_col, "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def taken(docs: DataFrame, id_col: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as ``sample`` takes it; rows that share id, source and size are taken alike.

    Decisions meet their rows by a hash of the three; those of many rows, as of null ids, are broadcast.
    """
    key = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null")), "_s", "size")
    times = decided(docs.select(id_col, "text", "source"), id_col, seed, ROWS_PER_CELL).select(key.alias("key"), "times")
    times = cut_lineage(times.groupBy("key").agg(F.max("times").alias("times"), F.count(F.lit(1)).alias("n")), "mix-times")
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole")
    rows = docs.select(whole, F.col(id_col), source_key(F.col("source")).alias("_s"), size_of(text_of()).alias("size")).select("whole", key.alias("key"))
    copies = join_sized(rows, times, "key", "n").where("times > 0").select("whole", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])
