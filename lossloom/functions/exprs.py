"""Column builders shared by all operators. Each returns a Column and plans into whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_index(d: Column | str) -> Column:
    """Calendar month number; differences count month boundaries, whatever the day."""
    return F.year(c(d)) * 12 + F.month(c(d))


def month_diff(start: Column | str, end: Column | str) -> Column:
    return month_index(end) - month_index(start)


def month_date(mi: Column | str) -> Column:
    """First day of a month number."""
    z = c(mi) - 1
    return F.make_date(F.floor(z / 12).cast("int"), (z % 12 + 1).cast("int"), F.lit(1))


def quarter_end(d: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(c(d), "quarter"), 2))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Null instead of a division by zero."""
    d = c(den)
    return F.when(d != 0, c(num) / d)


def ratio_if_positive(num: Column | str, den: Column | str) -> Column:
    d = c(den)
    return F.when(d > 0, c(num) / d)


def clip(x: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; null stays null (least/greatest alone would skip it)."""
    v = c(x)
    out = v
    if lo is not None:
        out = F.when(out < lo, F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(float(hi))).otherwise(out)
    return out


def flag(cond: Column) -> Column:
    """Condition as true/false, null counting as false."""
    return F.coalesce(cond, F.lit(False))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def wavg(value: Column | str, weight: Column | str) -> Column:
    return safe_div(F.sum(c(value) * c(weight)), F.sum(c(weight)))


def code_map(col: Column | str, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Chained WHEN over a small fixed code table."""
    expr = reduce(lambda acc, kv: acc.when(c(col) == kv[0], F.lit(kv[1])), mapping.items(), F.when(F.lit(False), F.lit(None)))
    return expr.otherwise(default) if default is not None else expr


def bucket(col: Column | str, edges: Sequence[float], labels: Sequence, *, closed: str = "right",
           lowest: bool = False, last_closed: bool = False) -> Column:
    """Label of the interval between consecutive edges; null outside all of them.

    ``closed`` names the closed side; ``lowest`` also takes the first edge (right-closed bins),
    ``last_closed`` also takes the last edge (left-closed bins).
    """
    v = c(col)
    expr = F.when(F.lit(False), F.lit(None))
    last = len(labels) - 1
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        if closed == "right":
            above = v >= F.lit(lo) if (lowest and i == 0) else v > F.lit(lo)
            below = v <= F.lit(hi)
        else:
            above = v >= F.lit(lo)
            below = v <= F.lit(hi) if (last_closed and i == last) else v < F.lit(hi)
        expr = expr.when(above & below, F.lit(label))
    return expr


def uniform_hash(*keys: Column | str) -> Column:
    """Portable uniform in [0, 1) from md5; the same text formula works in any SQL engine."""
    text = F.concat_ws("|", *[c(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def horner(x: Column, coefs: Sequence[float]) -> Column:
    """Polynomial, highest power first."""
    return reduce(lambda acc, k: acc * x + F.lit(k), coefs[1:], F.lit(coefs[0]))


# Rational approximations of the normal CDF (Hart 1968, West 2005) and quantile (Acklam 2003).
CDF_P = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
         221.213596169931, 220.206867912376)
CDF_Q = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
         637.333633378831, 793.826512519948, 440.413735824752)
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716,
         2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968,
         2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
CDF_LIMIT = 7.07
PPF_TAIL = 0.02425


def with_norm_cdf(df: DataFrame, out: str, x: Column | str) -> DataFrame:
    """Add the standard normal distribution function of ``x``.

    The argument is projected first: the polynomials read it many times, and an inlined argument would be repeated in
    the generated code each time.
    """
    df = df.withColumn("_x", c(x))
    v = F.col("_x")
    a = F.abs(v)
    tail = F.exp(-a * a / 2) * horner(a, CDF_P) / horner(a, CDF_Q)
    df = df.withColumn("_tail", tail)
    value = (F.when(v.isNull(), F.lit(None).cast("double"))
             .when(a >= CDF_LIMIT, F.when(v > 0, 1.0).otherwise(0.0))
             .when(v > 0, 1 - F.col("_tail")).otherwise(F.col("_tail")))
    return df.withColumn(out, value).drop("_x", "_tail")


def with_norm_ppf(df: DataFrame, out: str, p: Column | str) -> DataFrame:
    """Add the standard normal quantile of ``p``, for 0 < p < 1."""
    df = df.withColumn("_p", c(p))
    v = F.col("_p")
    df = df.withColumns({"_q": v - 0.5, "_r": (v - 0.5) * (v - 0.5), "_s": F.sqrt(-2 * F.ln(F.least(v, 1 - v)))})
    q, r, s = F.col("_q"), F.col("_r"), F.col("_s")
    tail = horner(s, PPF_C) / (horner(s, PPF_D) * s + 1)
    centre = horner(r, PPF_A) * q / (horner(r, PPF_B) * r + 1)
    value = F.when(v < PPF_TAIL, tail).when(v > 1 - PPF_TAIL, -tail).otherwise(centre)
    return df.withColumn(out, value).drop("_p", "_q", "_r", "_s")


def logit(p: Column | str) -> Column:
    v = c(p)
    return F.ln(v / (1 - v))


def expit(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-c(x)))


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide columns to (name, value) rows; a narrow projection, no shuffle."""
    return df.unpivot([F.col(k) for k in keys], [F.col(x).cast("double").alias(x) for x in cols], name, value)


def tagged_rows(df: DataFrame, keys: Sequence[str], rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One output row per entry of ``rows``, each a list of columns named by ``names``; one pass over ``df``."""
    structs = [F.struct(*[v.alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]
    return df.select(*keys, F.explode(F.array(*structs)).alias("r")).select(*keys, *[F.col(f"r.{n}").alias(n) for n in names])
