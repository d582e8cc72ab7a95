"""Phrase dictionaries against one pattern for each category, in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from textloom.functions.text import category_pattern
from textloom.operators import dictionaries, features
from textloom.sources.tables import table

PHRASES = {
    "smoke": ["peat", "peat_smoke", "peat_smoke_ash", "smoke", "smoke_peat"],
    "fruit": ["red_apple", "apple", "apple_red", "red_apple_red_apple", "pear"],
}


def dictionary(spark, phrases=None):
    return spark.createDataFrame([(c, t) for c, ts in (PHRASES if phrases is None else phrases).items() for t in ts], "category string, term string")


def by_pattern(text, category):
    return [re.sub(r"[\s_-]+", "_", m[0].lower()) for m in re.finditer(category_pattern(PHRASES[category]), text or "")]


def texts():
    r = random.Random(5)
    words, gaps = ["peat", "Smoke", "ash", "red", "APPLE", "pear", "peats", "x"], [" ", "  ", "-", "_", "\n", ", ", ". ", "'", "__", " - "]
    made = ["".join(w + r.choice(gaps) for w in r.choices(words, k=r.randint(1, 40))) for _ in range(300)]
    return [None, "", "   ", "_peat", "peat_", "peat_smoke_", "_red_apple", "red apple" * 3, "peat smoke " * 5000, *made]


def test_the_same_matches_as_a_pattern(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "k int, text string").repartition(5)
    got = {}
    for r in dictionaries.occurrences(df, "k", ["text"], dictionary(spark)).collect():
        got.setdefault((r.k, r.category), []).append((r.place, r.term))
    for k, text in rows:
        for c in PHRASES:
            assert [t for _, t in sorted(got.get((k, c), []))] == by_pattern(text, c), (text, c)


def test_a_shuffled_dictionary_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts())), "k int, text string")
    want = sorted(dictionaries.occurrences(df, "k", ["text"], dictionary(spark)).collect())
    monkeypatch.setattr(dictionaries, "BROADCAST_TERMS", 0)
    assert sorted(dictionaries.occurrences(df, "k", ["text"], dictionary(spark)).collect()) == want


def test_the_same_columns_as_patterns_on_documents(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", F.regexp_replace(F.lower("text"), "[^a-z]+", " ").alias("plain"))
    phrases = {"articles": ["the", "der", "die", "das"], "pairs": ["of_the", "in_the", "und_die"]}
    got = dictionaries.phrase_features(docs, "doc_id", ["text", "plain"], dictionary(spark, phrases), list(phrases))
    want = features.with_features(docs, ["text", "plain"], phrases, ["doc_id"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_odd_terms_and_empty_tables(spark):
    odd = {"a": ["", "__", "half-way", "half_way", "Peat", None], "b": ["l'eau"], None: ["x"]}
    df = spark.createDataFrame([(1, "half way, l'eau; l eau PEAT x")], "k int, text string")
    got = {(r.category, r.term) for r in dictionaries.occurrences(df, "k", ["text"], dictionary(spark, odd)).collect()}
    assert got == {("a", "half-way"), ("a", "Peat"), ("b", "l'eau")}
    none = dictionary(spark).limit(0)
    assert dictionaries.occurrences(df, "k", ["text"], none).count() == 0
    (row,) = dictionaries.phrase_features(df, "k", ["text"], none, ["a"]).collect()
    assert (row.a_text_count, row.a_text_per1k, row.a_text_binary, row.wordcount_text) == (0, 0.0, 0, 7)
    assert dictionaries.phrase_features(df.limit(0), "k", ["text"], none, ["a"]).count() == 0


def test_frequencies_count_terms_that_never_occur(spark):
    df = spark.createDataFrame([(1, "peat peat smoke"), (2, "peat")], "k int, text string")
    got = {r.term: (r.n, r.n_rows) for r in dictionaries.term_frequencies(df, "k", "text", dictionary(spark)).collect()}
    assert got["peat"] == (2, 2) and got["peat_smoke"] == (1, 1) and got["pear"] == (0, 0)


@pytest.mark.parametrize("broadcast", [True, False])
def test_words_are_not_shuffled_to_a_small_dictionary(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dictionaries, "BROADCAST_TERMS", 1000 if broadcast else 0)
    df = spark.createDataFrame([(1, "peat")], "k int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = dictionaries.occurrences(df, "k", ["text"], dictionary(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("BroadcastHashJoin" in plan) == broadcast and "Python" not in plan
