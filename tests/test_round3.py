"""Findings of the third round: odd keys, and forms that grow with the input."""

import difflib
import os
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from textloom.operators import embedding, html, linkage, relational, similarity, vectors
from textloom.plans import geometry, linking, shapes
from textloom.sources.tables import settled

PAGES = [
    (0, "http://a.org/0", "<a href='/x'>x</a><article><a href='/y'>y</a></article>"),
    (1, "http://a.org/0", "<a href='/y'>y</a><article><a href='/x'>x</a></article>"),
    (2, "http://a.org/2", "<a href='/z'>z<article></a><a href=\u00a0q>q</a>"),
    (4, "http://a.org/2", None),
    (5, None, "<A\u00a0 HREF=/w>w</A>"),
]


def against_sql(spark, tmp_path, tables, query, sql):
    """The query's rows and those of its SQL, both sorted."""
    db = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found, want = query(spark, str(tmp_path)), db.sql(sql)
    return sorted(map(str, (tuple(r[c] for c in want.columns) for r in found.collect()))), sorted(map(str, want.fetchall()))


def test_unseen_pages_of_one_url(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got, want = against_sql(spark, tmp_path, {"pages": pages}, *shapes.ALL["unseen_pages"])
    assert got == want and len(got) == 4


def test_navigation_of_one_url(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got, want = against_sql(spark, tmp_path, {"pages": pages}, *linking.ALL["navigation"])
    assert got == want
    assert {(r.href, r.kind) for r in html.split_links(pages.filter("page_id < 2"), "<article").collect()} == {("/x", "named"), ("/y", "named")}


def test_associations_without_pairs(spark, tmp_path):
    """What is joined to the targets is one row, however many attributes there are."""
    t = spark.range(400).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("id") + 1).cast("float")).alias("embedding"), (F.col("id") % 7).cast("int").alias("label"))
    t.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = geometry.associations(spark, str(tmp_path))
    got = {(r.term, r.side): r.s for r in found.collect()}
    want = {r[:2]: r[2] for r in duckdb.sql(geometry.ALL["associations"][1].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()}
    assert got.keys() == want.keys() and len(got) == 114 and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert "tl_lean" in found._jdf.queryExecution().optimizedPlan().toString().split("Join Cross")[1]


def test_sampled_permutations_sort_a_band_alone(spark, monkeypatch):
    """The same p as from a sort of all hashes, also where the band misses a cut."""
    df = spark.range(600).select(F.col("id").alias("term"), F.when(F.col("id") % 3 == 0, "X").otherwise("Y").alias("side"), (F.sin(F.col("id")) + F.when(F.col("id") % 3 == 0, 0.08).otherwise(0.0)).alias("s"))
    got = [df]
    for certain in (float("inf"), 3, 0):
        monkeypatch.setattr(vectors, "CERTAIN", certain)
        got.append(vectors.sampled_permutations(df, 300).first())
    assert got[1].n_permutations == 300 and 0.01 < got[1].p < 0.9 and got[1] == got[2] == got[3]


def test_linkage_keeps_no_pairs(spark, monkeypatch):
    """Nothing that is written grows with the product of the entries and records that have one link, day, name and score."""
    kept = []
    monkeypatch.setattr(linkage, "settled", lambda df: kept.append(df.count()) or settled(df))
    rows = spark.range(200).select(F.col("id").cast("string").alias("record"), F.lit("https://a.org/x").alias("link"), F.lit("some name").alias("name"), F.lit(80).alias("score"), F.lit("2020-01-01").alias("day"), F.concat(F.lit("text "), F.col("id") + 1000).alias("text"))
    index = rows.select(F.concat(F.lit("e"), "record").alias("entry"), "link", "name", "score", "day", F.when(F.col("record").cast("int") < 100, F.col("text")).otherwise("").alias("snippet"), F.lit("named").alias("page_kind"))
    found = linkage.linked(index, rows, 0).groupBy("method").count().collect()
    assert {(r["method"], r["count"]) for r in found} == {("exact_name_score_snippet", 100), ("fuzzy_low", 100)} and max(kept) == 200


def test_enriched_compares_distinct_names_without_an_equal(spark):
    """A name that the page has is not compared, others once a cell name: each comparison is a row of the comparing function."""
    n = F.col("id")
    entries = spark.range(120).select(F.concat(F.lit("e"), n).alias("entry"), F.lit("p").alias("link"), F.lit("d").alias("day"), F.when(n % 3 == 0, F.concat(F.lit("Lot "), n)).otherwise("Lot x").alias("name"))
    cells = spark.range(120).select(F.lit("p").alias("link"), F.lit("d").alias("day"), F.when(n % 3 == 0, F.concat(F.lit("lot  "), n)).otherwise("wwww").alias("cell_name"), n.cast("string").alias("cell_text"))
    compared = spark.sparkContext.accumulator(0)
    plain = linkage.difflib.SequenceMatcher

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([plain(None, x, y).ratio() for x, y in zip(a, b)])

    own, linkage.similarity = linkage.similarity, counted
    try:
        got = {r.entry: (r.cell_text, r.ratio) for r in linkage.enriched(entries, cells).collect()}
    finally:
        linkage.similarity = own
    assert len(got) == 120 and all(got[f"e{k}"] == ((str(k), 1.0) if k % 3 == 0 else ("0", 0.8)) for k in range(120))
    assert compared.value <= 2 * 41  # the filter and the column may each work the ratio out


def test_generated_rows_are_handed_on_by_size():
    class Frame:
        def mapInPandas(self, run, schema):
            return run

    pages = pd.DataFrame({"html": ["x" * 1_000_000] * 40})
    frames = list(html.generated(Frame(), "text string", lambda row: iter([(row["html"],)]))(iter([pages])))
    assert sum(map(len, frames)) == 40 and max(map(len, frames)) == 4


def test_skip_gram_sends_vectors_by_group(spark, monkeypatch):
    """What a round writes is bounded by groups, not shards, and is deleted after it."""
    kept = []
    monkeypatch.setattr(embedding, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    counted, plain = [], embedding.let_go
    monkeypatch.setattr(embedding, "let_go", lambda df: counted.append(df.count()) or plain(df), raising=False)
    words = spark.range(600).select(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(50)))).alias("words"))
    found = embedding.skip_gram(words, "words", shards=40, epochs=3).collect()
    assert len(found) == 50 and len(counted) == 6 and max(counted) <= embedding.FEWEST * 50
    folders = [df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0] for df in kept]
    assert [os.path.isdir("/" + f.lstrip("/")) for f in folders] == [False] * 6 + [True]


def test_similar_names_keep_no_pairs(spark):
    """Names whose pairs of neighbours are all frequent: nothing is joined on those, cells of any size give the same
    pairs, and few pairs that lack the ratio are compared in full."""
    r = random.Random(5)
    ours = ["".join(r.choice("abcdefgh") for _ in range(r.choice([9, 30, 32, 70]))) for _ in range(260)]
    theirs = [n[:3] + n[3 + r.choice([0, 1, 4, 9]) :] for n in ours]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(a, b): ratio(a, b) for a in set(ours) for b in set(theirs) if 2 * min(len(a), len(b)) >= 0.78 * (len(a) + len(b)) and ratio(a, b) >= 0.78}
    left = [(int(i), int(j)) for x, y in similarity.near(ours, theirs, 0.78) for i, j in zip(x, y)]
    assert want.keys() <= {(ours[i], theirs[j]) for i, j in left} and len(left) < 2 * len(want)
    frame = lambda names: spark.createDataFrame([("b", n) for n in names], "block string, name string")
    own = similarity.CELL
    for cell in (own, 40):
        similarity.CELL = cell
        try:
            found = similarity.similar_names(frame(ours), frame(theirs), 0.78)
        finally:
            similarity.CELL = own
        assert {(f.name, f.other): f.ratio for f in found.collect()} == want and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_by_cells(spark, tmp_path, monkeypatch):
    """Copies, multiples, and many cells, as the SQL has them; no pair is a row of a join, and nothing is broadcast."""
    r = random.Random(2)
    base = [[round(r.uniform(-1, 1), 2) for _ in range(5)] for _ in range(40)]
    rows = [(k, [x * (1 + k % 3) for x in base[k % 40]] if k < 900 else base[0], k % 3) for k in range(1200)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr("textloom.operators.cells.ANCHORS", 7)
    monkeypatch.setattr("textloom.operators.cells.VECTORS", 100)
    got, want = against_sql(spark, tmp_path, {"embeddings": t}, *geometry.ALL["neighbors"])
    assert got == want and len(got) == 240
    plan = geometry.neighbors(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_nearest_of_odd_vectors(spark):
    """Null vectors, components and keys, and vectors of another size, are similar to nothing and come last, by key."""
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", None), ("d", [1.0, None]), ("e", [1.0]), ("f", [-1.0, 0.0]), (None, [1.0, 0.0]), ("g", [1e-200, 0.0])]
    t = spark.createDataFrame(rows, "k string, v array<double>")
    got = [(x.neighbor, x.similarity) for x in relational.nearest(t, t.filter("k = 'a'"), 5, "k", "v").orderBy("rank").collect()]
    assert [n for n, _ in got][-4:] == ["b", "f", "c", "d"] and got[-2:] == [("c", None), ("d", None)] and got[2] == ("f", -1.0)
