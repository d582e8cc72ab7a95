"""Descriptive, comparative and regression statistics over distributed aggregates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.relational import running
from textloom.operators.selection import exact_quantiles


def described(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """A row for each column: n, mean, median, sd (n - 1), min and max, nulls and NaN left out."""
    long = df.select([F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]).unpivot([], columns, "variable", "value")
    r = lambda c: F.round(c, digits)
    sums = long.groupBy("variable").agg(F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    medians = exact_quantiles(long, "value", [0.5], ["variable"]).select("variable", r(F.col("quantiles")[0]).alias("median"))
    return sums.join(medians, "variable", "left").select("variable", "n", "mean", "median", "sd", "min", "max")


def shares(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Counts of values and their percentage of all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("tl_total")))
    return counts.crossJoin(total).withColumn("percent", F.round(100 * F.col("n") / F.col("tl_total"), digits)).drop("tl_total")


def skew(x: str) -> Column:
    """Skewness corrected for the sample's size."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def average_rank(column: str, by: list[str] | None = None) -> Column:
    """Ranks within groups in which ties share the mean of their places. Over a whole table they come from counts of
    distinct values instead; see ``spearman``."""
    own = Window.partitionBy(*(by or []))
    return F.rank().over(own.orderBy(column)) + (F.count("*").over(own.partitionBy(*(by or []), column)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns (complete rows), through counts of distinct values."""
    rows = df.select(a, b).dropna()

    def ranks(c: str) -> DataFrame:
        counts = running(rows.groupBy(c).agg(F.count("*").alias("n")), c, "n", "below")
        return counts.select(F.col(c).alias(f"of_{c}"), (F.col("below") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    both = rows.join(ranks(a), F.col(a) == F.col(f"of_{a}")).join(ranks(b), F.col(b) == F.col(f"of_{b}"))
    return both.agg(F.round(F.corr(f"rank_{a}", f"rank_{b}"), 6).alias("spearman"))


def correlations(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Pairwise correlations of complete pairs, long."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = df.agg(*[F.round(F.corr(a, b), digits).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "correlation")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "correlation")


def betacf(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * betacf(b, a, 1 - x) / b


def student_p(t: float, df: float) -> float | None:
    """Two-sided p of Student's t."""
    if t is None or df is None or not math.isfinite(t) or not df > 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def student_p_of(t: str, df: str) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b) for a, b in zip(t, df)])

    return run(t, df)


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def compared(df: DataFrame, groups: dict[str, Column], measures: list[str], digits: int = 6) -> DataFrame:
    """Each group against the rest for each measure: counts, means, Cohen's d (pooled by n), Welch's t, df and p.

    All groups and measures are aggregated in one pass; a null membership counts as the rest."""
    long = df.withColumns({f"tl_{k}": F.coalesce(c, F.lit(False)) for k, c in groups.items()}).select(*[f"tl_{k}" for k in groups], F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.nanvl(F.col(m).cast("double"), F.lit(None)).alias("value")) for m in measures])).alias("m")).select(*[f"tl_{k}" for k in groups], "m.*")
    aggs = [f(F.when(F.col(f"tl_{k}") == side, F.col("value"))).alias(f"{k}|{name}{int(side)}") for k in groups for side in (True, False) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    flat = long.groupBy("measure").agg(*aggs)
    rows = flat.select("measure", F.explode(F.array(*[F.struct(F.lit(k).alias("group"), *[F.col(f"{k}|{c}").alias(c) for c in ("n1", "m1", "v1", "n0", "m0", "v0")]) for k in groups])).alias("g")).select("measure", "g.*")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = F.when(a + b > 0, (F.col("m1") - F.col("m0")) / F.sqrt(a + b))
    freedom = F.when(a + b > 0, F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("n1") - 1) + F.pow(b, 2) / (F.col("n0") - 1)))
    r = lambda c: F.round(c, digits)
    return rows.select("group", "measure", F.col("n1").alias("n_group"), F.col("n0").alias("n_other"), r(F.col("m1")).alias("group_mean"), r(F.col("m0")).alias("other_mean"), r(F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled)).alias("cohen_d"), r(t).alias("welch_t"), r(freedom).alias("welch_df"))


def with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", student_p_of("welch_t", "welch_df"))


def mann_whitney(df: DataFrame, value: str, group: Column) -> DataFrame:
    """U of the group, and its two-sided p by the normal approximation with ties."""
    rows = df.select(F.col(value).alias("x"), F.coalesce(group, F.lit(False)).alias("g")).dropna()
    counts = rows.groupBy("x").agg(F.count("*").alias("n"), F.count_if("g").alias("n1"))
    ranked = running(counts, "x", "n", "below").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    one = ranked.agg(F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").alias("n1"), F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n0 = F.col("n") - F.col("n1")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * n0 / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    return one.select(u.alias("u"), F.round((u - F.col("n1") * n0 / 2) / sd, 6).alias("z"))


def holm(df: DataFrame, p: str, by: list[str] | None = None, tie: list[str] | None = None, name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values: the running maximum of (m - rank) p, at most 1."""
    own = Window.partitionBy(*(by or []))
    order = own.orderBy(p, *(tie or []))
    stepped = (F.count("*").over(own) - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("tl_step", stepped).withColumn(name, F.least(F.lit(1.0), F.max("tl_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("tl_step")


def z_scores(df: DataFrame, value: str, by: list[str], name: str = "z", floor: float = 1e-10) -> DataFrame:
    own = Window.partitionBy(*by)
    return df.withColumn(name, (F.col(value) - F.avg(value).over(own)) / (F.stddev_pop(value).over(own) + floor))


def design(y: str, numbers: list[str], factor: str | None, levels: list) -> tuple[list[str], list[Column]]:
    """Names and columns of the regressors: intercept, numbers, and a factor's levels but the first."""
    names, columns = ["intercept"], [F.lit(1.0)]
    for c in numbers:
        names.append(c)
        columns.append(F.col(c).cast("double"))
    for level in levels[1:]:
        names.append(f"{factor}[{level}]")
        columns.append((F.col(factor) == F.lit(level)).cast("double"))
    return names, columns


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    """Sums of the (weighted) products of all pairs of columns: one pass, k * k numbers come back."""
    k = len(columns)
    w = weight if weight is not None else F.lit(1.0)
    named = df.select(*[c.alias(f"x{j}") for j, c in enumerate(columns)], w.alias("w"))
    sums = named.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("w")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = sums[at] or 0.0
            at += 1
    return out


def least_squares(df: DataFrame, y: str, numbers: list[str], factor: str | None = None, robust: bool = True) -> pd.DataFrame:
    """Linear regression from sums of products: coefficients, standard errors (HC1, with normal inference, or classical
    with Student's), intervals, n and adjusted R squared. Rows with a null or NaN are left out.

    The rows stay distributed: one pass for the normal equations, one for the squared errors; only matrices of the
    number of regressors come to the driver."""
    used = [y, *numbers] + ([factor] if factor else [])
    rows = df.select(*used).dropna()
    levels = [r[0] for r in rows.select(factor).distinct().orderBy(factor).collect()] if factor else []
    names, columns = design(y, numbers, factor, levels)
    s = gram(rows, [*columns, F.col(y).cast("double")])
    xx, xy, yy, n, k = s[:-1, :-1], s[:-1, -1], s[-1, -1], s[0, 0], len(columns)
    inverse = np.linalg.pinv(xx)
    b = inverse @ xy
    rss, tss = yy - b @ xy, yy - s[0, -1] ** 2 / n
    if robust:
        error = F.col(y).cast("double") - reduce(lambda p, q: p + q, [c * float(v) for c, v in zip(columns, b)])
        cov = inverse @ gram(rows, columns, error * error) @ inverse * n / (n - k)
    else:
        cov = inverse * rss / (n - k)
    se = np.sqrt(np.maximum(0, np.diag(cov)))
    t = np.divide(b, se, out=np.full(k, np.nan), where=se > 0)
    p = [normal_p(x) if robust else student_p(x, n - k) for x in t]
    return pd.DataFrame({"variable": names, "b": b, "se": se, "ci_low": b - 1.959963984540054 * se, "ci_high": b + 1.959963984540054 * se, "statistic": t, "p": p, "n": int(n), "r2": 1 - rss / tss, "adj_r2": 1 - rss / tss * (n - 1) / (n - k)})


def poisson_weight(key: list[str], replicate: Column, seed: int) -> Column:
    """A Poisson(1) count from a hash of key, replicate and seed: the same for any partitioning."""
    u = (F.shiftrightunsigned(F.xxhash64(*key, replicate, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    out, below, term = F.when(F.lit(False), 0), 0.0, math.exp(-1)
    for count in range(12):
        below += term
        out = out.when(u < below, count)
        term /= count + 1
    return out.otherwise(12)


def bootstrap_r2(df: DataFrame, y: str, predicted: str, key: list[str], replicates: int = 200, seed: int = 42, digits: int = 6) -> DataFrame:
    """R squared of predictions, with a percentile interval over Poisson resamples; no rows are collected."""
    rows = df.select(*key, F.col(y).cast("double").alias("y"), F.col(predicted).cast("double").alias("f")).dropna()
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(poisson_weight(key, F.col("rep"), seed)))
    w = F.col("w")
    sums = drawn.groupBy("rep").agg(F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("s"), F.sum(w * F.col("y") * F.col("y")).alias("q"), F.sum(w * F.pow(F.col("y") - F.col("f"), 2)).alias("rss"))
    r2 = sums.select("rep", (1 - F.col("rss") / (F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("r2"))
    low, high = (F.percentile(F.when(F.col("rep") > 0, F.col("r2")), F.lit(q)) for q in (0.025, 0.975))
    return r2.agg(F.round(F.max(F.when(F.col("rep") == 0, F.col("r2"))), digits).alias("r2"), F.round(low, digits).alias("ci_low"), F.round(high, digits).alias("ci_high"))
