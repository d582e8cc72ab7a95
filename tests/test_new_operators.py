import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from textloom.operators import features, html, models, vectors
from textloom.sources import tables


def test_entries_of_an_index_page(spark):
    page = """<table><tr><td>Latest tasted <a href="archive1-1.html#010203">One</a></td></tr></table>
      <div><p>Text before <a href="archive1-1.html#010203">One</a></p><p><a href="archive1-1.html#010203">again</a></p>
      <li>Two <b>bold</b> notes <a href="/archive2-1.html#040506">Two</a></li><a href="archive3-1.html#070809">bare</a>
      <p>no date <a href="archive4-1.html">x</a> <a href="archive4-1.html#top">y</a> <a>z</a> other <a href="http://b.org/a.html#010101">b</a></p></div>"""
    rows = spark.createDataFrame([("http://a.org/d/i.html", page), (None, None), ("u", "<li>open <a href='x#010203'>never")], "url string, html string")
    got = {(r.dst, r.fragment, r.label, r.text) for r in html.index_entries(rows, "a.org", "latest tasted").collect()}
    assert got == {
        ("http://a.org/d/archive1-1.html", "010203", "One", "Text before"),
        ("http://a.org/archive2-1.html", "040506", "Two", "Two bold notes"),
        ("http://a.org/d/archive3-1.html", "070809", "bare", got_text(got, "070809")),
    }


def got_text(got, fragment):
    return next(t for _, f, _, t in got if f == fragment)


def test_rows_after_headers_and_page_jobs(spark):
    page = "<table><tr><td><b>Head a</b></td></tr><tr><td>x <i>y</i></td></tr><tr><td>Head b</td></tr></table>"
    rows = spark.createDataFrame([("u", page), ("v", None)], "url string, html string")
    assert [(r.header, r["next"]) for r in html.next_rows(rows, "^Head").collect()] == [("Head a", "x y")]
    jobs = html.page_jobs(spark.createDataFrame([("a/named-1.html",), ("a/named-1.html",), ("a/other.html",), ("a/x.pdf",), (None,)], "url string"), {"named": "named", "other": r"\.html$"})
    assert {(r.url, r.kind) for r in jobs.collect()} == {("a/named-1.html", "named"), ("a/other.html", "other")}


def test_pairs_are_joined_from_the_left(spark):
    cases = {"a b a b": "a_b a_b", "a a b": "a a_b", "a of the b": "a_of_the_b", "a of the of b": "a of the of b", "a of": "a of", "": "", "b of a b c": "b of a_b c", "a of c b": "a of c b"}
    rows = spark.createDataFrame([(k, k.split()) for k in cases], "k string, w array<string>")
    out = rows.select("k", F.array_join(features.joined_pairs(F.col("w"), F.array(F.lit("a b")), ("of", "the")), " ").alias("x"))
    assert {r.k: r.x for r in out.collect()} == cases


def test_plain_shuffles(spark):
    apart = spark.createDataFrame([("X", 1.0 + k / 10) for k in range(8)] + [("Y", k / 10) for k in range(8)], "side string, s double")
    found = vectors.shuffle_test(apart, 2000)
    assert abs(found["difference"] - 1.0) < 1e-9 and found["p"] < 0.01 and found["n_permutations"] == 2000
    even = spark.createDataFrame([("X", 0.5), ("Y", 0.5)] * 4, "side string, s double")
    assert vectors.shuffle_test(even, 200)["p"] == 1.0


def test_folds_are_equal_and_repeatable(spark):
    rows = spark.range(1003).withColumnRenamed("id", "k")
    one = {(r.k, r.fold) for r in models.folded(rows, ["k"], 5).collect()}
    assert one == {(r.k, r.fold) for r in models.folded(rows.repartition(7), ["k"], 5).collect()}
    assert sorted(sum(f == n for _, f in one) for n in range(5)) == [200, 200, 201, 201, 201]


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.replace_table(spark.range(5), path)
    tables.replace_table(spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    assert os.listdir(tmp_path) == ["t"]
    with pytest.raises(Exception):
        tables.replace_table(spark.range(3).select(F.raise_error(F.lit("stop")).alias("id")), path)
    assert spark.read.parquet(path).count() == 2


def test_the_entry_module_works_without_the_subpackage(tmp_path):
    """Also where the pipeline's file is still there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "textloom"):
        source, target = os.path.join(root, name), tmp_path / name
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, target)
    if os.path.exists(os.path.join(root, "corpus_pipeline.py")):
        shutil.copy(os.path.join(root, "corpus_pipeline.py"), tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and 'pipeline' not in q and not any(k.startswith('op1') for k in q) and set(s) < set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
