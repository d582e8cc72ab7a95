"""Exact quantiles of large groups: selection by places in the order, never a group's values in one task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.relational import running


def exact_quantiles(df: DataFrame, value: str | Column, probabilities: Iterable[float], by: Iterable[str] = ()) -> DataFrame:
    """*by and quantiles (an array) of the numbers in ``value``, by linear interpolation between the two next values.

    Equal values are counted first, by task and then whole; the distinct ones are dealt by ranges of (*by, value), and
    running counts over the ranges give each its places. Of a group only the values at the places that the
    probabilities fall on are kept. Nulls and NaN are left out; a group without numbers has no row.
    """
    by, probabilities = [*by], [*probabilities]
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(F.struct(*map(F.col, by), F.lit(0).alias("tl_0")).alias("tl_by"), F.nanvl(number, F.lit(None)).alias("tl_v")).dropna(subset=["tl_v"])
    counts = rows.groupBy("tl_by", "tl_v").agg(F.count("*").alias("tl_n")).withColumn("tl_key", F.struct("tl_by", "tl_v"))
    placed = running(counts, "tl_key", "tl_n", "tl_below")
    # places are counted over all groups; a group's own start at its least
    ends = placed.groupBy("tl_by").agg(F.min("tl_below").alias("tl_first"), F.sum("tl_n").alias("tl_all"))
    found = placed.join(ends, "tl_by")
    place = lambda p: (F.col("tl_all") - 1) * F.lit(float(p))
    covers = lambda at: (F.col("tl_first") + at >= F.col("tl_below")) & (F.col("tl_first") + at < F.col("tl_below") + F.col("tl_n"))
    wanted = [F.max(F.when(covers(edge(place(p)).cast("long")), F.col("tl_v"))) for p in probabilities for edge in (F.floor, F.ceil)]
    share = [F.max(place(p) - F.floor(place(p))) for p in probabilities]
    both = found.groupBy("tl_by").agg(*(w.alias(f"tl_w{k}") for k, w in enumerate(wanted)), *(s.alias(f"tl_s{k}") for k, s in enumerate(share)))
    quantile = [F.col(f"tl_w{2 * k}") + F.col(f"tl_s{k}") * (F.col(f"tl_w{2 * k + 1}") - F.col(f"tl_w{2 * k}")) for k in range(len(probabilities))]
    return both.select(*(F.col("tl_by")[c].alias(c) for c in by), F.array(*quantile).alias("quantiles"))
