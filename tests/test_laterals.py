"""Page parsers as table functions; clean records against plain Python; recursion, random splits, memberships."""

import hashlib
import itertools

from pyspark.sql import functions as F

from textloom.operators import html, lateral, linkage, vectors
from textloom.operators import relational as R


def pages(spark):
    long = "Colour: x. Nose: y. " + "z" * 80
    rows = [("http://a.org/p.html", f"<b>May 1, 2010</b><table><tr><td>{long}</td><td>{long}</td></tr></table><b>Feb 30, 2010</b><a href='q.html#x'>q</a>"), ("u", None), (None, ""), ("v", "<td>May 1, 2010")]
    return spark.createDataFrame(rows, "url string, html string")


def test_table_functions_give_what_the_frames_give(spark):
    p, heads = pages(spark), (r"<b>\s*(\w+ \d+, \d{4})</b>",)
    got = lateral.parsed_by(spark, r"SELECT p.url, d.day, d.part, d.fragment FROM {pages} p, LATERAL day_fragments(p.html, array(r'<b>\s*(\w+ \d+, \d{{4}})</b>')) d", pages=p)
    want = html.days(p, heads)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() == 1
    cells = lateral.parsed_by(spark, "SELECT d.url, d.day, c.text FROM {days} d, LATERAL record_cells(d.fragment, array('Colour:', 'Nose:'), '', 80) c", days=got)
    assert [(r.day, r.text[:7]) for r in cells.collect()] == [("2010-05-01", "Colour:")]
    links = lateral.parsed_by(spark, "SELECT p.url AS src, l.* FROM {pages} p, LATERAL page_links(p.url, p.html) l", pages=p)
    assert sorted(links.collect()) == sorted(html.links(p).select("src", "dst", "label").collect())


def test_a_null_array_or_table_without_rows(spark):
    assert lateral.parsed_by(spark, "SELECT d.* FROM {pages} p, LATERAL day_fragments(p.html, array('x')) d", pages=pages(spark).limit(0)).count() == 0


def clean(spark, rows):
    df = spark.createDataFrame(rows, "id int, name string, text string, `a.b` string")
    return lateral.cleaned_records(df, r"END \d+", r"Lot \d+ \(", ("Colour:",), r"END (\d+)", least=10)


def test_clean_records(spark):
    one = lambda k, s: f"Lot {k} (46%, cask) intro. Colour: gold and long. END {s}"
    rows = [(1, "n", one(1, 80), "x"), (2, "n", one(2, 81) + "  " + one(3, 82), "y"), (3, " Given (50%) tail", "Colour: only a body", None), (4, "", "Colour: nothing to name it", None), (5, "S", "Colour: too short a name", None), (6, None, None, None), (7, "Kept", "", None)]
    got = sorted((r.id, r.part, r.name, r.text, r.score, r["a.b"]) for r in clean(spark, [*rows]).collect() if r.id < 7)
    assert got == [
        (1, 0, "Lot 1 (46%, cask)", one(1, 80), 80, "x"),
        (2, 0, "Lot 2 (46%, cask)", one(2, 81), 81, "y"),
        (2, 1, "Lot 3 (46%, cask)", one(3, 82), 82, "y"),
        (3, 0, "Given (50%)", "Given (50%) Colour: only a body", None, None),
    ]
    for r in clean(spark, rows).collect():
        assert r.content_key == hashlib.sha256(r.text.encode()).hexdigest()
    assert clean(spark, rows[:0] or [(9, None, None, None)]).count() == 0


def test_reach_with_cycles_both_ways(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (7, 8), (2, 3), (None, 5), (5, None)]
    links, seeds = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(1,), (1,)], "node int")
    want = {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {tuple(r) for r in R.reachable(links, seeds).collect()} == want
    assert {tuple(r) for r in R.reachable_shallow(links, seeds, 5).collect()} == want
    assert {tuple(r) for r in R.reachable_shallow(links, seeds, 1).collect()} == {(1, 0), (2, 1)}
    assert {tuple(r) for r in R.reachable(links, seeds, 2).collect()} == {(1, 0), (2, 1)}
    assert R.reachable(links, seeds.limit(0)).count() == 0


def exact_p(scores):
    s, k = [x for _, _, x in scores], sum(side == "X" for _, side, _ in scores)
    own = sum(x for _, side, x in scores if side == "X")
    sums = [sum(s[i] for i in c) for c in itertools.combinations(range(len(s)), k)]
    return (sum(x >= own - 1e-12 for x in sums) + 1) / (len(sums) + 1)


def test_random_splits_near_the_exact_test(spark):
    scores = [(k, "X" if k % 2 else "Y", ((k * 37) % 11 - 5) / 7 + (k % 2) * 0.35) for k in range(14)]
    df = spark.createDataFrame(scores, "term int, side string, s double").repartition(3)
    want = exact_p(scores)
    got = vectors.sampled_permutations(df, 4000).first()
    assert got.n_permutations == 4000 and abs(got.p - want) < 5 * (want * (1 - want) / 4000) ** 0.5
    assert vectors.sampled_permutations(df.repartition(1), 4000).first().p == got.p
    few = vectors.permuted(df, 4000).first()
    assert few.n_permutations == 3432 and abs(few.p - want) < 1e-12


def test_several_tests_at_once(spark):
    rows = [(t, k, "X" if k < 4 else "Y", float((k * 7 + t) % 5)) for t in (1, 2) for k in range(9)] + [(3, 1, "X", 1.0)]
    df = spark.createDataFrame(rows, "test int, term int, side string, s double")
    got = {r.test: r.p for r in vectors.sampled_permutations(df, 300, by=("test",)).collect()}
    alone = {t: vectors.sampled_permutations(df.filter(F.col("test") == t), 300).first().p for t in (1, 2)}
    assert got == alone


def test_memberships(spark):
    matches = spark.createDataFrame([("e1", "r1", "exact_link"), ("e2", "r1", "fuzzy_low"), ("e3", None, "unmatched"), ("e4", "r2", "exact_link")], "entry string, record string, method string")
    index = spark.createDataFrame([(f"e{k}", f"page{k}") for k in range(1, 5)], "entry string, page string")
    corpus = spark.createDataFrame([("r1", "h1"), ("r2", "  ")], "record string, h string")
    got = {tuple(r) for r in linkage.memberships(matches, index, corpus, "h", ["page"]).collect()}
    assert got == {("h1", "e1", "page1", "exact_link"), ("h1", "e2", "page2", "fuzzy_low")}
