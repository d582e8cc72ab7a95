from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import values as V
from textloom.operators import governance, html, linkage, models, predicates, vectors
from textloom.sources import tables
from textloom.streaming import ingest


def test_more_columns(spark):
    row = (
        spark.createDataFrame([("Name here Colour: gold. Score: 88 points", 2.0, 5.0, 5.0, "2012-01-09")], "t string, a double, b double, c double, d string")
        .select(
            T.before_marker(F.col("t"), ("Colour:",)).alias("head"),
            T.number_after(F.col("t"), r"(\d+) points").alias("n"),
            T.number_after(F.col("t"), r"(\d+) stars").alias("none"),
            V.first_of_largest(["a", "b", "c"]).alias("top"),
            V.full_year(F.lit(69)).alias("y1"),
            V.full_year(F.lit(70)).alias("y2"),
            V.same_day(F.col("d"), F.lit(None)).alias("same"),
            predicates.cell(F.lit(0.12345), F.lit(0.01), F.lit(0.002)).alias("cell"),
            vectors.raw_dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("dot"),
            html.link_pattern(F.lit('<a href="b.html"><a href="a.html"><a href="b.html">'), r'href="([a-z]+\.html)"').alias("links"),
        )
        .first()
    )
    assert (row.head, row.n, row.none, row.top, row.y1, row.y2, row.same) == ("Name here", 88, None, "b", 2069, 1970, False)
    assert row.cell == "0.123** (0.010)" and row.dot == 11.0 and row["links"] == ["a.html", "b.html"]


def test_enrichment_takes_the_most_similar_cell(spark):
    entries = spark.createDataFrame([("e1", "u", "d", "Acorn 10"), ("e2", "u", "d", "Acorn Ten yo"), ("e3", "u", "x", "Acorn")], "entry string, link string, day string, name string")
    cells = spark.createDataFrame([("u", "d", "acorn  10", "one"), ("u", "d", "Zzz", "two")], "link string, day string, cell_name string, cell_text string")
    got = {r.entry: (r.cell_text, r.ratio) for r in linkage.enriched(entries, cells).collect()}
    assert got["e1"] == ("one", 1.0) and got["e2"][0] == "one" and 0.52 <= got["e2"][1] < 1 and got["e3"] == (None, None)


def test_candidates_and_categories(spark):
    prior = spark.createDataFrame([("oaks", "wood"), ("salt", "sea")], "term string, prior string")
    more = spark.createDataFrame([("salt", "x"), ("oak", "wood"), ("odd", "y")], "term string, prior string")
    gone = spark.createDataFrame([("odd",)], "term string")
    found = governance.candidates(prior, more, gone, F.regexp_replace("term", "s$", ""), [("short", F.length("term") < 4), ("salty", F.col("term") == "salt")])
    assert {(r.term, r.prior, r.ambiguous_because) for r in found.collect()} == {("salt", "sea", "salty"), ("oak", "wood", "short")}
    category = governance.proposed(F.col("term"), F.col("prior"), {"oak": "tree"}, {"fig": "fruit"}, [("sea", F.col("term") == "salt", "mineral")])
    rows = spark.createDataFrame([("oak", "wood"), ("fig", None), ("salt", "sea"), ("kelp", "sea")], "term string, prior string")
    assert [r.c for r in rows.select(category.alias("c")).collect()] == ["tree", "fruit", "mineral", "sea"]
    assert governance.value_of(rows, "prior", F.col("term") == "kelp") == "sea" and governance.value_of(rows, "prior", F.col("term") == "none") is None
    after = rows.withColumn("prior", F.when(F.col("term") == "fig", "fruit").otherwise(F.col("prior")))
    assert [(r.term, r.before, r.after) for r in governance.changed(rows, after, "term", "prior").collect()] == [("fig", None, "fruit")]


def test_sources_with_places_names_and_counts(spark, tmp_path):
    frame = spark.createDataFrame([("a", "bb"), ("c", "ccc"), ("d", "bb")], "k string, name string")
    tables.write_csv(frame.repartition(2), f"{tmp_path}/c", ["k", "name"])
    read = tables.csv_in_order(spark, f"{tmp_path}/c", frame.schema)
    assert read.count() == 3 and read.select("file", "place").distinct().count() == 3
    assert sum(r.n for r in tables.file_counts(spark.read.option("header", True).csv(f"{tmp_path}/c")).collect()) == 3
    assert [r.name for r in tables.names_by_length(frame, "name").collect()] == ["ccc", "bb"]
    tables.write_lines(frame, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 3
    assert tables.manifest(frame.agg(F.count("*").alias("n"))).first().manifest == '{"n":3}'


def test_models_over_grids(spark):
    words = ["oak", "ash", "elm", "salt", "sand", "kelp"]
    rows = [(k, " ".join(words[(k * j + j) % 6] for j in range(1, 12)), float(k % 5)) for k in range(60)]
    frame = spark.createDataFrame(rows, "k int, t string, y double")
    assert models.best_ridge(frame, ["k"], "y", "t", (0.01, 1.0), 2) in (0.01, 1.0)
    tokens = frame.select(T.tokens(F.col("t")).alias("w"))
    poles = spark.createDataFrame([("d", 1, "oak"), ("d", 1, "ash"), ("d", -1, "salt"), ("d", -1, "sand")], "dimension string, sign int, term string")
    terms = spark.createDataFrame([("tree", "elm"), ("sea", "kelp"), ("tree", "oak")], "category string, term string")
    grid = models.stability(tokens, "w", poles, terms, [(4, 3, 1), (4, 3, 2)], 1).collect()
    assert [(r.seed, r.widest) for r in grid] == [(1, "d"), (2, "d")] and all(r.spreads["d"] >= 0 for r in grid)
    assert models.score_linear(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v", [3.0, 4.0]).first().score == 11.0


def test_windowed_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 4.0)], "ts string, kind string, v double").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.windowed(ingest.files(spark, f"{tmp_path}/in", rows.schema), "ts", "1 hour", ["kind"], "v")
    query = stream.writeStream.format("memory").queryName("tl_windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.kind, r.n, r.total) for r in spark.table("tl_windows").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}
