import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import features, governance, html, linkage, models, relational, stats, vectors
from textloom.sources import tables
from textloom.streaming import ingest


def test_student_and_normal_p():
    assert abs(stats.student_p(2.0, 10) - 0.07338803) < 1e-7 and abs(stats.student_p(1.0, 1) - 0.5) < 1e-12
    assert abs(stats.normal_p(1.959963984540054) - 0.05) < 1e-12 and stats.student_p(float("nan"), 3) is None


def test_robust_regression_against_matrices(spark):
    r = np.random.default_rng(1)
    x, g = r.normal(size=200), r.integers(0, 3, 200)
    y = 1 + 2 * x + (g == 2) + r.normal(size=200) * (1 + np.abs(x))
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(y, x, g)] + [(None, 1.0, 1), (1.0, float("nan"), 2)]
    fit = stats.least_squares(spark.createDataFrame(rows, "y double, x double, g int"), "y", ["x"], "g")
    m = np.column_stack([np.ones(200), x, g == 1, g == 2]).astype(float)
    inverse = np.linalg.inv(m.T @ m)
    b = inverse @ m.T @ y
    e = y - m @ b
    cov = inverse @ (m.T * e**2) @ m @ inverse * 200 / 196
    assert np.allclose(fit.b, b) and np.allclose(fit.se, np.sqrt(np.diag(cov))) and fit.n[0] == 200
    classical = stats.least_squares(spark.createDataFrame(rows, "y double, x double, g int"), "y", ["x"], "g", robust=False)
    assert np.allclose(classical.se, np.sqrt(np.diag(inverse) * (e @ e) / 196))


def test_holm_is_monotone_and_bounded(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9, 0.9]
    got = stats.holm(spark.createDataFrame([(k, v) for k, v in enumerate(p)], "k int, p double"), "p", tie=["k"]).orderBy("p", "k").collect()
    want, high = [], 0
    for k, v in enumerate(sorted(p)):
        high = max(high, min(1, (6 - k) * v))
        want.append(high)
    assert np.allclose([r.p_holm for r in got], want)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [(k, float(k % 17), float(k % 17) + (k % 5) / 3) for k in range(300)]
    frame = spark.createDataFrame(rows, "k int, y double, f double")
    a, b = (stats.bootstrap_r2(frame.repartition(n), "y", "f", ["k"], 40).first() for n in (1, 5))
    assert a == b and a.ci_low <= a.r2 <= a.ci_high


def test_tiers_count_the_first_reason(spark):
    frame = spark.createDataFrame([(1, 5, None), (2, None, None), (3, 50, "b"), (4, 50, None)], "k int, n int, t string")
    kept, dropped = relational.tiered(frame, [("no_n", F.col("n").isNull()), ("small", F.col("n") < 10)], [("one", F.col("t") == "b")])
    assert [(r.k, r.tier) for r in kept.collect()] == [(3, "one")]
    assert {r.drop_reason: r.n for r in dropped.collect()} == {"small": 1, "no_n": 1, "no_tier": 1}


def test_longest_name_wins_at_letter_boundaries(spark):
    texts = spark.createDataFrame([(1, "the Glen Oak and Oak"), (2, "Oakley"), (3, "x-oak!"), (4, None)], "k int, t string")
    names = spark.createDataFrame([("Oak",), ("Glen Oak",), ("x (odd",)], "name string")
    assert {r.k: r.name for r in relational.longest_name(texts, "t", names, "name", ["k"]).collect()} == {1: "Glen Oak", 2: None, 3: "Oak", 4: None}


def test_priority_and_canonical(spark):
    a = spark.createDataFrame([("x", 1)], "term string, v int")
    b = spark.createDataFrame([("x", 2), ("apples", 3), ("apple", 4), ("pears", 5)], "term string, v int")
    whole = relational.priority_union([a, b], ["term"])
    assert {r.term: r.v for r in whole.collect()} == {"x": 1, "apples": 3, "apple": 4, "pears": 5}
    left = relational.unless_canonical(whole, "term", F.regexp_replace("term", "s$", ""))
    assert {r.term for r in left.collect()} == {"x", "apple", "pears"}


INDEX = "entry string, link string, name string, score int, day string, snippet string, page_kind string"
CORPUS = "record string, link string, name string, score int, day string, text string"


def test_linkage_tiers(spark):
    corpus = spark.createDataFrame(
        [
            ("r1", "http://a.org/1", "Acorn 10", 80, "2012-01-01", "text one"),
            ("r2", "http://a.org/2", "Beech 12", 85, "2012-01-02", "text two"), ("r3", "http://a.org/2", "Cedar 12", 85, "2012-01-02", "text three"),
            ("r4", "http://a.org/4", "Elm 20", 90, "2012-01-04", "text four"), ("r5", "http://a.org/5", "Fir 5", 70, "2012-01-05", "smoke and honey"), ("r6", "http://a.org/6", "Fir 5", 70, "2012-01-06", "salt and lime"),
            ("r7", "http://a.org/7", "Hazel Single Cask 1990", 77, "2012-01-07", "t"),
        ],
        CORPUS,
    )
    index = spark.createDataFrame(
        [
            ("e1", "HTTP://A.org/1#x", "other", 1, "2012-01-01", "", "named"),
            ("e2", "http://a.org/2", "CEDAR  12", 85, "2012-01-02", "", "named"),
            ("e3", "http://b.org", "Elm 20", 90, "2012-01-04", "", "auxiliary"),
            ("e4", "http://b.org", "Fir 5", 70, "2012-01-06", "Salt and", "named"),
            ("e5", "http://b.org", "Fir 5", 70, "2012-01-06", "", "named"),
            ("e6", "http://b.org", "Hazel Single Casks 1990", 77, "2012-01-07", "", "named"),
            ("e7", "http://b.org", "Nothing", 5, "2012-01-07", "", "named"),
            ("e8", "http://a.org/4", "Elm 20", 90, "2012-01-04", "", "named"),
        ],
        INDEX,
    )
    got = {r.entry: (r.record, r.method) for r in linkage.linked(index, corpus).collect()}
    assert got == {"e1": ("r1", "exact_link"), "e2": ("r3", "exact_link"), "e3": ("r4", "exact_name_score"), "e4": ("r6", "exact_name_score_snippet"), "e5": ("r5", "fuzzy_low"), "e6": ("r7", "fuzzy_high"), "e7": (None, "unmatched"), "e8": ("r4", "exact_link")}
    best = {r.record: r for r in linkage.winners(linkage.linked(index, corpus), index, corpus).collect()}
    assert best["r4"].entry == "e8" and best["r4"].strict and best["r4"].n_entries == 2 and not best["r7"].strict and best["r7"].expanded and best["r2"].entry is None
    reasons = {r.entry: r.reasons for r in linkage.audited(linkage.linked(index, corpus), index, corpus).collect()}
    assert reasons["e7"] == "unmatched" and "several_entries" in reasons["e3"] and "fuzzy" in reasons["e5"]


PAGE = """<html><script>var a="</td>";</script><body>
<font color="#1">January 9, 2012</font><table><tr><td><span class="bold name">Acorn (51%, cask)</span> Colour: gold Nose: {0} Mouth: ok Finish: long. 88 points</td><td>short</td></tr></table>
<font color="#1">February 31, 2012</font><table><tr><td>Colour: lost Nose: {0} Mouth: x</td></tr></table>
<font color="#1">January 10,
2012</font><table><tr><td>Beech (46%) Colour: pale Nose: {0} Palate: y</td></tr></table></body></html>""".format("n" * 80)


def test_pages_to_records(spark):
    pages = spark.createDataFrame([("u", PAGE), ("v", None)], "url string, html string")
    days = html.days(pages, (r"<font[^>]*>\s*([A-Z][a-z]+\s+\d{1,2},\s*\d{4})\s*</font>",))
    assert [r.day for r in days.orderBy("part").collect()] == ["2012-01-09", "2012-01-10"]
    found = html.records(days, ("Colour:", "Nose:", "Mouth|Palate:"), "name").orderBy("day").collect()
    assert [(r.title, r.score) for r in found] == [("Acorn (51%, cask)", 88), ("Beech (46%)", None)] and "lost" not in found[0].text


def test_links_and_splits(spark):
    page = spark.createDataFrame([("http://a.org/x/", '<a href="b.html#f">B</a><a href="/c">C <b>d</b></a><p>MARK</p><a href="b.html#f">again</a><a href="z">Z</a>')], "url string, html string")
    assert {(r.dst, r.label) for r in html.links(page).collect()} == {("http://a.org/x/b.html", "B"), ("http://a.org/c", "C d"), ("http://a.org/x/z", "Z")}
    assert {(r.href, r.kind) for r in html.split_links(page, "MARK").collect()} == {("b.html#f", "named"), ("/c", "named"), ("z", "auxiliary")}
    two = "Acorn (51%) " + "a" * 90 + " END 5. Beech (46%) " + "b" * 90 + " END 6."
    parts = html.split_records(spark.createDataFrame([("k", two), ("l", "one only"), ("m", None)], "key string, text string"), r"END \d\.", r"[A-Z][a-z]+ \(").orderBy("key", "part").collect()
    assert [(r.key, r.text[:5]) for r in parts] == [("k", "Acorn"), ("k", "Beech"), ("l", "one o"), ("m", "")]


def test_association_test_against_enumeration(spark):
    r = np.random.default_rng(2)
    x = [(f"t{k}", "X" if k < 4 else "Y", r.normal(size=5).tolist()) for k in range(8)]
    a = [("A" if k < 3 else "B", r.normal(size=5).tolist()) for k in range(6)]
    got = vectors.association_test(spark.createDataFrame(x, "term string, side string, vector array<double>"), spark.createDataFrame(a, "set string, vector array<double>"))
    cos = lambda u, v: np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)
    s = np.array([np.mean([cos(v, w) for n, w in a if n == "A"]) - np.mean([cos(v, w) for n, w in a if n == "B"]) for _, _, v in x])
    own = s[:4].sum() - s[4:].sum()
    sums = [2 * s[list(c)].sum() - s.sum() for c in itertools.combinations(range(8), 4)]
    assert got["n_permutations"] == math.comb(8, 4) and abs(got["p"] - (sum(v >= own - 1e-12 for v in sums) + 1) / 71) < 1e-12
    assert abs(got["effect"] - (s[:4].mean() - s[4:].mean()) / s.std(ddof=1)) < 1e-9
    with pytest.raises(ValueError, match="overlap"):
        vectors.association_test(spark.createDataFrame([*x, ("t0", "Y", x[0][2])], "term string, side string, vector array<double>"), spark.createDataFrame(a, "set string, vector array<double>"))


def test_axes_need_two_known_terms(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "term string, vector array<double>")
    poles = spark.createDataFrame([("d", 1, "a"), ("d", 1, "c"), ("d", -1, "b"), ("d", -1, "zz")], "dimension string, sign int, term string")
    with pytest.raises(ValueError, match="fewer than 2"):
        vectors.axes(v, poles)


def test_folds_cover_each_row_once(spark):
    rows = [(k, float(k % 7), float(k % 7 * 2 + 1), "ab"[k % 2]) for k in range(200)]
    frame = spark.createDataFrame(rows, "k int, x double, y double, g string")
    found = models.out_of_fold(frame, ["k"], "y", models.linear("y", ["x"], "g"))
    assert found.count() == 200 and found.select("k").distinct().count() == 200
    assert models.metrics(found, "y").first().r2_oof > 0.999
    b = models.gram_ridge(frame, "y", ["x"], 0.0)
    assert np.allclose(b, [1, 2])
    low, high = models.bootstrap_adj_r2(frame.withColumn("y", F.col("y") + F.col("k") % 3), ["k"], "y", ["x"], 20)
    assert 0 < low <= high <= 1


def test_governance(spark):
    sheet = spark.createDataFrame([("oak", "wood", 12, "approved", "", "r"), ("oak", "wood", 12, "approved", "", "r"), ("", "x", 2, "odd", "", "")], ", ".join(f"{c} {'int' if c == 'review_frequency' else 'string'}" for c in governance.WORKSHEET))
    found = {r.error for r in governance.errors(sheet, ["wood", "fruit"]).collect()}
    assert found == {"approved twice: oak", "blank term: ", "unknown status: ", "blank rationale: ", "empty category: fruit"}
    with pytest.raises(ValueError, match="approved twice"):
        governance.frozen(sheet, ["wood", "fruit"])
    good = governance.frozen(sheet.filter("term <> ''").dropDuplicates(), ["wood"]).first().dictionary
    assert good == '{"wood":{"term_count":1,"terms":["oak"]}}'
    assert [r.error for r in governance.errors(sheet.drop("status"), []).collect()] == ["missing columns: status"]
    counts = governance.marker_counts({"clean": sheet.withColumn("t", F.lit("88 points"))}, ["t"], {"points": r"\d+ points"})
    with pytest.raises(ValueError, match="points"):
        governance.gate(counts, "clean", "t")


def test_features_and_short_names(spark):
    with pytest.raises(ValueError, match="repeated"):
        features.short_names({"a": {"short_name": "x", "terms": []}, "b": {"short_name": "x", "terms": []}})
    made = features.with_features(spark.createDataFrame([(1, "Oak oak_wood", ""), (2, None, "x")], "k int, t string, u string"), ["t", "u"], {"wood": ["oak", "oak_wood"]}, ["k"]).orderBy("k").collect()
    assert (made[0].wood_t_count, made[0].wood_t_binary, made[0].wood_u_per1k) == (2, 1, None) and made[1].wordcount_t == 0


def test_sources_and_sinks(spark, tmp_path):
    rows = [("a,1", 'say "x"\nnew', "2012-01-09"), ("b", "", "2012-02-01")]
    frame = spark.createDataFrame(rows, "k string, t string, day string")
    tables.write_csv(frame.coalesce(1), f"{tmp_path}/c", ["k", "t", "day"])
    back = tables.csv(spark, f"{tmp_path}/c", frame.schema, blank_is_value=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_csv(frame, f"{tmp_path}/c", ["k"])
    tables.append_by_month(frame.withColumn("day", F.to_date("day")), f"{tmp_path}/m", "day")
    tables.replace_partitions(frame.limit(1).withColumn("ym", F.lit("2012_01")).withColumn("day", F.to_date("day")), f"{tmp_path}/m", ["ym"])
    assert {(r.k, r.ym) for r in spark.read.parquet(f"{tmp_path}/m").collect()} == {("a,1", "2012_01"), ("b", "2012_02")}
    (tmp_path / "l.jsonl").write_text('{"url": "http://a"}\nhttp://b\n\n')
    assert {r.url for r in tables.json_lines(spark, f"{tmp_path}/l.jsonl").collect()} == {"http://a", "http://b"}
    (tmp_path / "d.json").write_text('{"status": "draft", "categories": {}}')
    with pytest.raises(ValueError, match="frozen"):
        tables.dictionary(spark, f"{tmp_path}/d.json")
    (tmp_path / "d.json").write_text('{"status": "frozen", "categories": {"Wood": {"short_name": "wood", "terms": ["oak"]}}}')
    assert [tuple(r) for r in tables.dictionary(spark, f"{tmp_path}/d.json").collect()] == [("Wood", "wood", "oak")]
    assert tables.markdown(frame.select("k").limit(1)).startswith("| k |")


def test_stream_goes_on_and_drops_what_it_has_seen(spark, tmp_path):
    rows = spark.createDataFrame([("x", "2012-01-01"), ("y", "2012-02-01"), ("x", "2012-01-01")], "text string, day string").withColumn("day", F.to_date("day"))
    for k in range(2):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows.filter("text = 'y'").withColumn("text", F.lit(f"z{k}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.once(ingest.files(spark, f"{tmp_path}/in", rows.schema), "text")
        ingest.append_months(stream, "day", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["x", "y", "z0", "z1"]


def test_reachable_is_bounded_by_what_links_lead_to(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "src long, dst long")
    got = {(r.node, r.depth) for r in relational.reachable(links, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2)}
