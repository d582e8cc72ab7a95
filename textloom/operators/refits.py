"""Many regressions from few passes: scopes, samples and scenarios are rows of one aggregation of sums of products.

A fit needs no more of its rows than the sums of products of its columns, so all fits of one shape come from a single
grouped aggregation, and a scenario that changes one column of a fit is that fit's sums with one row and one column
moved: only rows that the scenario touches are read for it. The small systems are solved on the executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.stats import design, gram

FITS = "variable string, b double, n long, r2 double, adj_r2 double"


def solved(s: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Coefficients, R squared and its adjusted form from the sums of products (intercept first, target last)."""
    b = np.linalg.pinv(s[:-1, :-1]) @ s[:-1, -1]
    n, k = s[0, 0], len(b)
    total = s[-1, -1] - s[0, -1] ** 2 / n
    r2 = 1 - (s[-1, -1] - b @ s[:-1, -1]) / total if total > 0 else np.nan
    return b, r2, 1 - (1 - r2) * (n - 1) / (n - k) if n > k else np.nan


def square(values: Iterable[float], k: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle, by rows."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = [0.0 if v is None else v for v in values]
    return out + np.triu(out, 1).T


def grouped_fits(rows: DataFrame, by: list[str], names: list[str], columns: list[Column], y: Column) -> DataFrame:
    """A row for each group and coefficient: *by and FITS. ``columns`` begin with the intercept; rows in which any of them
    or ``y`` is null or NaN are left out. A group of any size is summed by task first."""
    k = len(columns) + 1
    named = rows.select(*by, *(F.nanvl(c.cast("double"), F.lit(None)).alias(f"tl_x{j}") for j, c in enumerate([*columns, y])))
    products = [F.sum(F.col(f"tl_x{i}") * F.col(f"tl_x{j}")).alias(f"tl_s{i}_{j}") for i in range(k) for j in range(i, k)]
    sums = named.dropna(subset=[f"tl_x{j}" for j in range(k)]).groupBy(*by).agg(F.array(*products).alias("tl_s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                s = square(row.pop("tl_s"), k)
                b, r2, adjusted = solved(s)
                yield pd.DataFrame({**row, "variable": names, "b": b, "n": int(s[0, 0]), "r2": r2, "adj_r2": adjusted})

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return sums.mapInPandas(run, f"{kinds}, {FITS}")


def scope_fits(df: DataFrame, y: str, scopes: Mapping[str, list[str]], counts: Mapping[str, str], names: list[str], factor: str | None = None) -> DataFrame:
    """scope, sample and FITS of the regression of ``y`` on each scope's columns, called by ``names`` in all of them, and
    the levels of ``factor``. The sample ``common`` has the rows whose counts are positive in all scopes, ``own`` those
    with a positive count in the scope."""
    levels = [r[0] for r in df.select(factor).dropna().distinct().orderBy(factor).collect()] if factor else []
    every = F.lit(True)
    for c in counts.values():
        every = every & F.coalesce(F.col(c) > 0, F.lit(False))
    parts = F.array(*(F.struct(F.lit(s).alias("scope"), F.lit(sample).alias("sample"), F.coalesce(test, F.lit(False)).alias("used"), *(F.col(c).cast("double").alias(n) for n, c in zip(names, columns))) for s, columns in scopes.items() for sample, test in (("common", every), ("own", F.col(counts[s]) > 0))))
    rows = df.select(F.col(y).alias("tl_y"), *([F.col(factor).alias("tl_factor")] if factor else []), F.explode(parts).alias("part")).filter("part.used").select("tl_y", *(["tl_factor"] if factor else []), "part.*")
    called, columns = design("tl_y", names, "tl_factor" if factor else None, levels)
    called = [c.replace("tl_factor", factor) for c in called] if factor else called
    return grouped_fits(rows, ["scope", "sample"], called, columns, F.col("tl_y"))


def scenario_fits(df: DataFrame, key: list[str], y: str, numbers: list[str], changes: DataFrame, factor: str | None = None) -> DataFrame:
    """scenario, variable, base_b, scenario_b, delta_b and sign_changed of the changed column in every scenario.

    ``changes`` (scenario, variable, *key, amount) says what a scenario adds to one of ``numbers`` in a row; a row that it
    has several times gets the sum. The base is summed in one pass over ``df``, the scenarios in one over ``changes``."""
    used = [*key, y, *numbers, *([factor] if factor else [])]
    rows = df.select(*used).dropna(subset=used[len(key) :])
    levels = [r[0] for r in rows.select(factor).distinct().orderBy(factor).collect()] if factor else []
    called, columns = design(y, numbers, factor, levels)
    columns = [*columns, F.col(y).cast("double")]
    base = gram(rows, columns)
    before = solved(base)[0]
    place = {c: called.index(c) for c in numbers}

    added = changes.filter(F.col("variable").isin(numbers)).groupBy("scenario", "variable", *key).agg(F.sum(F.col("amount").cast("double")).alias("tl_d")).filter("tl_d <> 0")
    moved = added.join(rows, key).select("scenario", "variable", "tl_d", *(c.alias(f"tl_x{j}") for j, c in enumerate(columns)))
    sums = moved.groupBy("scenario", "variable").agg(F.array(*(F.sum(F.col("tl_d") * F.col(f"tl_x{j}")) for j in range(len(columns)))).alias("tl_c"), F.sum(F.col("tl_d") * F.col("tl_d")).alias("tl_q"))
    # a scenario that touches no row that is used changes nothing
    every = changes.select("scenario", "variable").distinct().filter(F.col("variable").isin(numbers)).join(sums, ["scenario", "variable"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                at, s = place[row["variable"]], base.copy()
                if row["tl_c"] is not None:
                    move = np.array(row["tl_c"], float)
                    s[at] += move
                    s[:, at] += move
                    s[at, at] += row["tl_q"]
                now = solved(s)[0][at]
                yield pd.DataFrame({"scenario": [row["scenario"]], "variable": [row["variable"]], "base_b": [before[at]], "scenario_b": [now], "delta_b": [now - before[at]], "sign_changed": [bool(np.sign(now) != np.sign(before[at]))]})

    return every.mapInPandas(run, f"scenario {changes.schema['scenario'].dataType.simpleString()}, variable string, base_b double, scenario_b double, delta_b double, sign_changed boolean")
