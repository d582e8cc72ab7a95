"""Queries of statistics: descriptions, shares, ranks, comparisons, tests, bins, regression, prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import values as V
from textloom.operators import models, refits, stats
from textloom.operators.relational import long
from textloom.operators.selection import exact_quantiles
from textloom.sources.tables import settled, table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GROUPS = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'"}


def described(spark, sf):
    return stats.described(table(spark, sf, "lineitem"), COLUMNS)


DESCRIBED_SQL = " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS sd, min({c}) AS min, max({c}) AS max FROM lineitem" for c in COLUMNS)


def quantiles(spark, sf):
    d = table(spark, sf, "documents")
    q = exact_quantiles(d, "n_chars", [0.25, 0.5, 0.75], ["lang"])
    return d.groupBy("lang").agg(F.round(stats.skew("n_chars"), 6).alias("skew")).join(q, "lang").select("lang", *[F.round(F.col("quantiles")[k], 6).alias(f"q{k + 1}") for k in range(3)], "skew")


def correlations(spark, sf):
    return stats.correlations(table(spark, sf, "lineitem"), COLUMNS)


CORRELATIONS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for k, a in enumerate(COLUMNS) for b in COLUMNS[k + 1 :])

AVERAGE_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
SPEARMAN_SQL = f"WITH r AS (SELECT {AVERAGE_RANK.format(c='l_quantity')} AS a, {AVERAGE_RANK.format(c='l_extendedprice')} AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r"


def compared(spark, sf):
    return stats.compared(table(spark, sf, "lineitem"), {k: F.expr(t) for k, t in GROUPS.items()}, COLUMNS)


COMPARED_SQL = """
WITH g AS (%s), s AS (
  SELECT g AS "group", measure, count(x) FILTER (WHERE i) AS n1, count(x) FILTER (WHERE NOT i) AS n0, avg(x) FILTER (WHERE i) AS m1, avg(x) FILTER (WHERE NOT i) AS m0,
         var_samp(x) FILTER (WHERE i) AS v1, var_samp(x) FILTER (WHERE NOT i) AS v0 FROM g GROUP BY ALL)
SELECT "group", measure, n1 AS n_group, n0 AS n_other, round(m1, 6) AS group_mean, round(m0, 6) AS other_mean,
  round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohen_d,
  round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS welch_t,
  round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 6) AS welch_df FROM s
""" % " UNION ALL ".join(f"SELECT '{k}' AS g, '{c}' AS measure, {t} AS i, {c} AS x FROM lineitem" for k, t in GROUPS.items() for c in COLUMNS)


def tested(spark, sf):
    """The comparison with its p-values, and those adjusted within each group."""
    return stats.holm(stats.with_p(compared(spark, sf)), "p", ["group"], ["measure"]).select("group", "measure", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


def holm(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", ((F.col("p_partkey") * 37 % 101) / 1000.0).alias("p"))
    return stats.holm(p, "p", ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey", F.round("p_holm", 6).alias("p_holm"))


HOLM_SQL = """
WITH p AS (SELECT p_brand, p_partkey, (p_partkey * 37 % 101) / 1000.0 AS p FROM part),
s AS (SELECT *, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) + 1) * p AS step FROM p)
SELECT p_brand, p_partkey, round(least(1.0, max(step) OVER (PARTITION BY p_brand ORDER BY p, p_partkey))::DOUBLE, 6) AS p_holm FROM s
"""


def mann_whitney(spark, sf):
    return stats.mann_whitney(table(spark, sf, "documents"), "n_chars", F.col("lang") == "en")


MANN_SQL = f"""
WITH d AS (SELECT n_chars, lang = 'en' AS g FROM documents), r AS (SELECT n_chars, g, {AVERAGE_RANK.format(c='n_chars')} AS r FROM d),
t AS (SELECT sum(n ** 3 - n) AS t FROM (SELECT count(*)::DOUBLE AS n FROM d GROUP BY n_chars)),
s AS (SELECT sum(r) FILTER (WHERE g) AS r1, (count(*) FILTER (WHERE g))::DOUBLE AS a, count(*)::DOUBLE AS n FROM r)
SELECT (r1 - a * (a + 1) / 2)::DOUBLE AS u, round((r1 - a * (a + 1) / 2 - a * (n - a) / 2) / sqrt(a * (n - a) / 12 * (n + 1 - t / (n * (n - 1)))), 6) AS z FROM s, t
"""


def bins(spark, sf):
    d = table(spark, sf, "documents")
    label = V.right_closed(F.col("n_chars"), [0, 200, 1000, 5000, 1e9], ["tiny", "short", "middle", "long"])
    return d.groupBy(label.alias("bin"), V.fixed_width(F.col("n_chars") % 1000, 100).cast("long").alias("width")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


BINS_SQL = "SELECT CASE WHEN n_chars > 0 AND n_chars <= 200 THEN 'tiny' WHEN n_chars > 200 AND n_chars <= 1000 THEN 'short' WHEN n_chars > 1000 AND n_chars <= 5000 THEN 'middle' WHEN n_chars > 5000 THEN 'long' END AS bin, (floor(n_chars % 1000 / 100.0) * 100)::BIGINT AS width, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1, 2"


def z_scores(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("mean"))
    return stats.z_scores(o, "mean", ["o_orderpriority"]).select("o_orderpriority", "o_orderstatus", F.round("z", 6).alias("z"))


Z_SQL = "WITH m AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2) SELECT o_orderpriority, o_orderstatus, round((mean - avg(mean) OVER w) / (stddev_pop(mean) OVER w + 1e-10), 6) AS z FROM m WINDOW w AS (PARTITION BY o_orderpriority)"


def melted(spark, sf):
    t = table(spark, sf, "labels")
    return long(t, ["doc_id"], ["quality", "toxic"]).groupBy("variable").agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def line_fit(spark, sf):
    """A regression with one number, as sums of products give it."""
    fit = stats.least_squares(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], robust=False)
    return spark.createDataFrame([(r.variable, round(float(r.b), 4), round(float(r.r2), 6), int(r.n)) for r in fit.itertuples()], "variable string, b double, r2 double, n long")


LINE_SQL = "WITH r AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS s, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem) SELECT 'intercept' AS variable, round(a, 4) AS b, round(r2, 6) AS r2, n FROM r UNION ALL SELECT 'l_quantity', round(s, 4), round(r2, 6), n FROM r"


def robust_fit(spark, sf):
    fit = stats.least_squares(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_returnflag")
    return spark.createDataFrame([(r.variable, *(round(float(x), 6) for x in (r.b, r.se, r.statistic, r.adj_r2))) for r in fit.itertuples()], "variable string, b double, se double, statistic double, adj_r2 double")


def out_of_fold(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").cast("double").alias("month"), F.length("o_orderpriority").cast("double").alias("size"), "o_orderstatus")
    return models.metrics(models.out_of_fold(d, ["o_orderkey"], "o_totalprice", models.linear("o_totalprice", ["month", "size"], "o_orderstatus")), "o_totalprice")


def text_ridge(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("y"))
    return models.metrics(settled(models.nested_ridge(d, ["doc_id"], "y", "text", inner=3)), "y")


def bootstrap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("y"), (F.length("text") * 0.9 + F.col("doc_id") % 500).alias("f"))
    return stats.bootstrap_r2(d, "y", "f", ["doc_id"], 2000)


def scope_fits(spark, sf):
    """The price by quantity and by discount, each on its own lines and on those that both have."""
    l = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", (F.col("l_orderkey") % 3).alias("n_quantity"), (F.col("l_partkey") % 4).alias("n_discount"))
    fits = refits.scope_fits(l, "l_extendedprice", {"quantity": ["l_quantity"], "discount": ["l_discount"]}, {"quantity": "n_quantity", "discount": "n_discount"}, ["x"])
    return fits.select("scope", "sample", "variable", F.round("b", 3).alias("b"), "n", F.round("r2", 6).alias("r2"), F.round("adj_r2", 6).alias("adj_r2"))


SCOPE_SQL = " UNION ALL ".join(
    f"""SELECT '{scope}' AS scope, '{sample}' AS sample, '{variable}' AS variable, round({fit}(l_extendedprice, l_{scope}), 3) AS b, count(*) AS n, round(regr_r2(l_extendedprice, l_{scope}), 6) AS r2,
round(1 - (1 - regr_r2(l_extendedprice, l_{scope})) * (count(*) - 1) / (count(*) - 2), 6) AS adj_r2 FROM lineitem WHERE {test}"""
    for scope, own in (("quantity", "l_orderkey % 3 > 0"), ("discount", "l_partkey % 4 > 0"))
    for sample, test in (("own", own), ("common", "l_orderkey % 3 > 0 AND l_partkey % 4 > 0"))
    for variable, fit in (("intercept", "regr_intercept"), ("x", "regr_slope"))
)


def scenario_fits(spark, sf):
    """What the slope of a number becomes if the orders of a priority counted more of it, for each priority."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 50).alias("x"), "o_orderpriority")
    changes = o.select(F.col("o_orderpriority").alias("scenario"), F.lit("x").alias("variable"), "o_orderkey", (F.col("o_orderkey") % 7).alias("amount"))
    fits = refits.scenario_fits(o, ["o_orderkey"], "o_totalprice", ["x"], changes)
    return fits.select("scenario", "variable", *[F.round(c, 3).alias(c) for c in ("base_b", "scenario_b", "delta_b")], "sign_changed")


SCENARIO_SQL = """
WITH o AS (SELECT o_totalprice AS y, o_custkey % 50 AS x, o_orderkey % 7 AS more, o_orderpriority AS p FROM orders),
b AS (SELECT regr_slope(y, x) AS base FROM o),
s AS (SELECT k, regr_slope(y, x + CASE WHEN p = k THEN more ELSE 0 END) AS now FROM o, (SELECT DISTINCT p AS k FROM o) GROUP BY k)
SELECT k AS scenario, 'x' AS variable, round(base, 3) AS base_b, round(now, 3) AS scenario_b, round(now - base, 3) AS delta_b, sign(now) <> sign(base) AS sign_changed FROM s, b
"""


ALL = {
    "described": (described, DESCRIBED_SQL),
    "shares": (lambda s, d: stats.shares(table(s, d, "documents"), "lang"), "SELECT lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY lang"),
    "quantiles": (quantiles, "SELECT lang, round(quantile_cont(n_chars, 0.25), 6) AS q1, round(quantile_cont(n_chars, 0.5), 6) AS q2, round(quantile_cont(n_chars, 0.75), 6) AS q3, round(skewness(n_chars), 6) AS skew FROM documents GROUP BY lang"),
    "correlations": (correlations, CORRELATIONS_SQL),
    "spearman": (lambda s, d: stats.spearman(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), SPEARMAN_SQL),
    "compared": (compared, COMPARED_SQL),
    "tested": (tested, None),
    "holm": (holm, HOLM_SQL),
    "mann_whitney": (mann_whitney, MANN_SQL),
    "bins": (bins, BINS_SQL),
    "z_scores": (z_scores, Z_SQL),
    "melted": (melted, "SELECT 'quality' AS variable, sum(quality)::BIGINT AS total, count(quality) AS n FROM labels UNION ALL SELECT 'toxic', sum(toxic)::BIGINT, count(toxic) FROM labels"),
    "line_fit": (line_fit, LINE_SQL),
    "robust_fit": (robust_fit, None),
    "scope_fits": (scope_fits, SCOPE_SQL),
    "scenario_fits": (scenario_fits, SCENARIO_SQL),
    "out_of_fold": (out_of_fold, None),
    "text_ridge": (text_ridge, None),
    "bootstrap": (bootstrap, None),
}
