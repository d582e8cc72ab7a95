"""Exact quantiles against numpy."""

import random

import numpy as np
import pytest

from textloom.operators import governance, predicates, stats
from textloom.operators.selection import exact_quantiles

PROBABILITIES = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("ties", [3, 10_000])
def test_groups_against_numpy(spark, ties):
    r = random.Random(ties)
    rows = [(r.choice(["a", "a", "a", "b", None, "lone"]), r.choice([1, 2]), r.choice([None, float("nan"), -0.5, float(r.randrange(ties)), float(r.randrange(ties))])) for _ in range(3000)]
    rows = [x for x in rows if x[0] != "lone"] + [("lone", 1, 7.0), ("none", 1, None), ("none", 2, float("nan"))]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, h int, v double").repartition(5), "v", PROBABILITIES, ["g", "h"]).collect()
    groups = {}
    for g, h, v in rows:
        if v is not None and v == v:
            groups.setdefault((g, h), []).append(v)
    assert {(x.g, x.h): pytest.approx(x.quantiles) for x in got} == {k: list(np.quantile(v, PROBABILITIES)) for k, v in groups.items()}


def test_whole_table_and_empty_table(spark):
    rows = spark.createDataFrame([(k % 97, "x") for k in range(1000)], "v int, tl_v string")
    assert exact_quantiles(rows, "v", [0.5, 0.99]).first().quantiles == pytest.approx(list(np.quantile([k % 97 for k in range(1000)], [0.5, 0.99])))
    assert exact_quantiles(rows.limit(0), "v", [0.5]).collect() == []


def test_users_of_quantiles(spark):
    rows = spark.createDataFrame([(k, float(k * 7 % 50) if k % 9 else None, 2000 + k % 3, "t") for k in range(200)], "k int, v double, y int, t string")
    values = [k * 7 % 50 for k in range(200) if k % 9]
    assert stats.described(rows, ["v"]).first().median == np.median(values)
    assert governance.summary(rows, "k", "v", "y", ["t"]).first().score_median == np.median(values)
    assert governance.summary(rows.limit(0), "k", "v", "y", ["t"]).first().score_median is None
    cut = {"v": 0.75, "k": 0.5}
    found = predicates.above_quantile(rows, cut).filter("above").count()
    assert found == sum(1 for k in range(200) if k % 9 and k * 7 % 50 > np.quantile(values, 0.75) and k > np.quantile(range(200), 0.5))
