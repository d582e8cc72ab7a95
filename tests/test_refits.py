"""Grouped and updated regressions against dense least squares."""

import random

import numpy as np
import pytest

from textloom.operators import refits


def dense(rows, columns, y):
    x = np.column_stack([np.ones(len(rows)), *([float(r[c]) for r in rows] for c in columns)])
    t = np.array([float(r[y]) for r in rows])
    b = np.linalg.lstsq(x, t, rcond=None)[0]
    r2 = 1 - ((t - x @ b) ** 2).sum() / ((t - t.mean()) ** 2).sum()
    return b, r2, 1 - (1 - r2) * (len(t) - 1) / (len(t) - x.shape[1])


def frame(spark, n=400):
    r = random.Random(3)
    rows = [dict(id=k, y=r.gauss(50, 5) + k % 4, a_t=r.random() * 9, b_t=r.random(), a_u=r.random() * 3, b_u=r.random() * 2, n_t=r.choice([0, 5, 9]), n_u=r.choice([0, 7, None]), year=r.choice([2001, 2002, 2003])) for k in range(n)]
    rows += [dict(rows[0], id=n, y=None), dict(rows[1], id=n + 1, a_t=None, a_u=float("nan"))]
    return rows, spark.createDataFrame([tuple(x.values()) for x in rows], "id int, y double, a_t double, b_t double, a_u double, b_u double, n_t int, n_u int, year int")


def test_scopes_against_dense_fits(spark):
    rows, df = frame(spark)
    got = refits.scope_fits(df.repartition(3), "y", {"t": ["a_t", "b_t"], "u": ["a_u", "b_u"]}, {"t": "n_t", "u": "n_u"}, ["a", "b"]).collect()
    usable = [x for x in rows if x["y"] is not None and x["a_t"] is not None]
    for scope in "tu":
        for sample in ("common", "own"):
            some = [x for x in usable if (x[f"n_{scope}"] or 0) > 0 and (sample == "own" or ((x["n_t"] or 0) > 0 and (x["n_u"] or 0) > 0))]
            b, r2, adjusted = dense(some, [f"a_{scope}", f"b_{scope}"], "y")
            mine = {g.variable: g for g in got if (g.scope, g.sample) == (scope, sample)}
            assert [mine[v].b for v in ("intercept", "a", "b")] == pytest.approx(list(b))
            assert (mine["a"].n, mine["a"].r2, mine["a"].adj_r2) == (len(some), pytest.approx(r2), pytest.approx(adjusted))
    assert refits.scope_fits(df.limit(0), "y", {"t": ["a_t"]}, {"t": "n_t"}, ["a"]).collect() == []


@pytest.mark.parametrize("factor", [None, "year"])
def test_scenarios_against_refits(spark, factor):
    rows, df = frame(spark)
    r = random.Random(9)
    hits = [(s, v, r.randrange(405), r.choice([0.5, 2.0])) for s, v in (("more a", "a_t"), ("more b", "b_t"), ("all a", "a_t")) for _ in range(150)]
    hits += [("nothing", "a_t", 10_000, 1.0), ("other column", "c", 1, 1.0)]
    got = {g.scenario: g for g in refits.scenario_fits(df.repartition(3), ["id"], "y", ["a_t", "b_t"], spark.createDataFrame(hits, "scenario string, variable string, id int, amount double"), factor).collect()}
    usable = [dict(x, **{f"y{v}": x["year"] == v for v in (2002, 2003)}) for x in rows if x["y"] is not None and x["a_t"] is not None]
    columns = ["a_t", "b_t"] + (["y2002", "y2003"] if factor else [])
    base = dense(usable, columns, "y")[0]
    assert set(got) == {"more a", "more b", "all a", "nothing"} and got["nothing"].delta_b == 0
    for name, g in got.items():
        changed = [dict(x, **{g.variable: x[g.variable] + sum(h[3] for h in hits if h[0] == name and h[2] == x["id"])}) for x in usable]
        at = 1 + columns.index(g.variable)
        now = dense(changed, columns, "y")[0][at]
        assert (g.base_b, g.scenario_b) == (pytest.approx(base[at]), pytest.approx(now))
        assert g.sign_changed == (np.sign(now) != np.sign(base[at]))
