"""The cascade of links is whole at any size, and its SQL holds at every one; pages are made and read by tasks of bounded size."""

import duckdb
import numpy as np
import pytest

from tests.conftest import SF
from tests.test_oracles import plain
from textloom.operators import embedding, html, linkage
from textloom.plans import linking


@pytest.mark.parametrize("name", ["linked", "link_audit", "memberships", "strict_records"])
def test_links_of_the_smallest_tables_are_those_of_the_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "part"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    query, sql = linking.ALL[name]
    found = query(spark, SF)
    columns = sorted(found.columns)
    want = db.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_a_name_of_other_spelling_is_found_in_a_corpus_of_any_size(spark):
    schema = "record string, link string, name string, score int, day string, text string"
    word = lambda k: "".join(chr(97 + int(d)) for d in f"{k * 7919 % 100000:05}")
    many = spark.createDataFrame([(f"r{k:05}", None, f"{word(k)} {word(k + 1)}", 1000 + k % 50, None, "") for k in range(linkage.POOL + 1)], schema)
    few = [("s1", None, "Acorn reserve of old", 70, "2020-01-01", ""), ("s2", None, "Birch reserve of old", 71, "2020-01-02", ""), ("s3", None, "Birch reserve of old!", 71, "2020-01-02", "")]
    index = [("e1", None, "The acorn reserve of old", 70, "2020-01-01", "", "named"), ("e2", None, "The birch reserve of old", 71, "2020-01-02", "", "named"), ("e3", None, "The acorn reserve of old", None, "2020-01-03", "", "named"), ("e4", None, "zzzz", 70, "2020-01-01", "", "named")]
    i = spark.createDataFrame(index, "entry string, link string, name string, score int, day string, snippet string, page_kind string")
    got = {r.entry: (r.record, r.method, r.confidence) for r in linkage.linked(i, many.union(spark.createDataFrame(few, schema))).collect()}
    assert got == {"e1": ("s1", "fuzzy_high", 0.9091), "e2": ("s2", "fuzzy_low", 0.9091), "e3": ("s1", "fuzzy_low", 0.9091), "e4": (None, "unmatched", 0.0)}


def test_pages_are_made_by_tasks_that_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(linking, "PAGED", 50)
    pages = linking.day_pages(spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    spread = pages.rdd.getNumPartitions()
    assert spread == orders // 50
    found = {tuple(r) for r in linking.page_records(spark, SF).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    assert found == set(db.sql(linking.PAGE_SQL).select("day, title, score, doubtful").fetchall())


def test_page_records_in_one_pass_are_those_of_the_fragments(spark):
    heads = (r"<font[^>]*>\s*([A-Z][a-z]+\s+\d{1,2},\s*\d{4})\s*</font>",)
    pages, rules = linking.day_pages(spark, SF), (("Colour:", "Nose:", "Mouth|Palate:"), "name")
    one = html.page_records(pages, heads, *rules)
    two = html.records(html.days(pages, heads), *rules)
    assert one.columns == two.columns and sorted(one.collect()) == sorted(two.collect())
    # a single Python worker of a task holds the page
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(one).count("MapInPandas") * 2 == plan(two).count("MapInPandas")


def test_a_step_of_neighbouring_words_is_the_step_of_their_pairs():
    r = np.random.default_rng(5)
    ids, text = r.integers(0, 12, 300), np.repeat([0, 1, 2], 100)
    met, steps = [], 0
    for near, band, first in embedding.bands(ids, text, 4, r):
        vin, vout = (r.normal(size=(12, 6)).astype(np.float32) * 0.3 for _ in range(2))
        noise = r.integers(0, 12, 7)
        i, j = np.nonzero(band)
        one, two = [vin.copy(), vout.copy()], [vin.copy(), vout.copy()]
        embedding.band_step(*one, near, band, first, noise, 3, 0.01)
        embedding.step(*two, near[first + i], near[j], noise, 3, 0.01)
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(one, two)) and not np.allclose(one[0], vin, atol=1e-5)
        met.append(len(i))
        steps += 1
    words, _ = embedding.pairs(ids, text, 4, np.random.default_rng(5))  # the same widths, drawn first
    again = sum(int(b.sum()) for _, b, _ in embedding.bands(ids, text, 4, np.random.default_rng(5)))
    assert steps > 1 and again == len(words)
