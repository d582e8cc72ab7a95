"""Dictionaries of phrases as a table: any number of terms in one pass over the texts.

A text is cut into words and the gaps between them. Every word that begins a term meets the term in a join on that word,
and the words and gaps that follow are compared; within a category the earliest and, at one place, the longest term
counts, and matches don't overlap. These are the counts that one pattern for each category gives, without a pattern.

Only occurrences are shuffled, by row and category: the words meet the dictionary by broadcast while it has at most
``BROADCAST_TERMS`` terms, and in a shuffled join beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import blank, word_count
from textloom.functions.values import rate
from textloom.sources.tables import settled

#: Letters, digits and marks make words; underscores, hyphens and white space part the words of a phrase.
WORD, GAP = r"[\p{L}\p{Nd}\p{Mn}]", r"[\s_-]+"
BROADCAST_TERMS = 100_000


def pieces(text: Column) -> Column:
    """Words and the gaps between them, in turn; nothing of the text is left out."""
    return F.regexp_extract_all(F.lower(blank(text)), F.lit(rf"{WORD}+|[^{WORD[1:-1]}]+"), F.lit(0))


def level(piece: Column) -> Column:
    """A piece as it is compared: a gap of nothing but separators is a space."""
    return F.when(piece.rlike(rf"^{GAP}$"), " ").otherwise(piece)


def prepared(terms: DataFrame) -> DataFrame:
    """Terms (category, term) by their first word. Of terms that differ in separators alone the first by name stays;
    terms without words, and null ones, match nothing."""
    plain = F.regexp_replace(F.lower("term"), rf"^[^{WORD[1:-1]}]+|[^{WORD[1:-1]}]+$", "")
    own = terms.select("category", "term", F.transform(pieces(plain), level).alias("tl_p")).filter("category IS NOT NULL AND size(tl_p) > 0")
    phrase = own.select("category", "term", F.get("tl_p", F.lit(0)).alias("tl_first"), F.size("tl_p").alias("tl_size"), F.array_join("tl_p", "").alias("tl_phrase"))
    return phrase.groupBy("category", "tl_phrase", "tl_first", "tl_size").agg(F.min("term").alias("term"))


def occurrences(df: DataFrame, key: str, scopes: list[str], terms: DataFrame) -> DataFrame:
    """(key, scope, category, term, place) for each match; ``place`` counts words and gaps from 0. ``key`` is unique."""
    known = settled(prepared(terms))
    size, most = known.agg(F.count("*"), F.coalesce(F.max("tl_size"), F.lit(1))).first()
    known = F.broadcast(known) if size <= BROADCAST_TERMS else known

    read = df.select(F.col(key).alias("tl_key"), F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), pieces(F.col(s)).alias("p")) for s in scopes])).alias("s")).select("tl_key", "s.*")
    # What follows a word travels with it, as far as the longest term and the gap after it reach.
    at = F.transform("p", lambda x, k: F.struct(k.alias("place"), x.alias("word"), F.get(F.col("p"), k - 1).alias("before"), F.slice("p", k + 1, most + 1).alias("ahead")))
    starts = read.select("tl_key", "scope", F.explode(F.filter(at, lambda x: x["word"].rlike(f"^{WORD}"))).alias("w")).select("tl_key", "scope", "w.*")
    free = ~F.coalesce(F.endswith("before", F.lit("_")), F.lit(False)) & ~F.coalesce(F.startswith(F.get("ahead", F.col("tl_size")), F.lit("_")), F.lit(False))
    same = F.array_join(F.transform(F.slice("ahead", F.lit(1), F.col("tl_size")), level), "") == F.col("tl_phrase")
    met = starts.join(known, F.col("word") == F.col("tl_first")).filter(free & same)

    hit = F.struct("place", (-F.length("tl_phrase")).alias("longest"), (F.col("place") + F.col("tl_size")).alias("end"), "term")
    hits = met.groupBy("tl_key", "scope", "category").agg(F.array_sort(F.collect_list(hit)).alias("h"))
    start = F.struct(F.lit(0).alias("free"), F.expr("CAST(array() AS array<struct<term: string, place: int>>)").alias("out"))

    def step(state, h):
        taken = F.struct(h["end"].alias("free"), F.concat(state["out"], F.array(F.struct(h["term"].alias("term"), h["place"].alias("place")))).alias("out"))
        return F.when(h["place"] >= state["free"], taken).otherwise(state)

    kept = F.aggregate("h", start, step, lambda state: state["out"])
    return hits.select(F.col("tl_key").alias(key), "scope", "category", F.explode(kept).alias("tl_kept")).select(key, "scope", "category", "tl_kept.*")


def phrase_features(df: DataFrame, key: str, scopes: list[str], terms: DataFrame, categories: list[str]) -> DataFrame:
    """The columns of ``features.with_features`` for a dictionary table: word counts, counts, rates and indicators."""
    found = occurrences(df, key, scopes, terms).filter(F.col("category").isin(categories))
    names = [f"{c}_{s}_count" for s in scopes for c in categories]
    wide = found.groupBy(F.col(key).alias("tl_key")).agg(*[F.count_if((F.col("category") == c) & (F.col("scope") == s)).alias(f"{c}_{s}_count") for s in scopes for c in categories])
    rows = df.select(key, *[word_count(F.col(s)).alias(f"wordcount_{s}") for s in scopes]).join(wide, F.col(key).eqNullSafe(F.col("tl_key")), "left").drop("tl_key").fillna(0, names)
    made = [x for s in scopes for c in categories for x in (F.col(f"{c}_{s}_count"), rate(F.col(f"{c}_{s}_count"), F.col(f"wordcount_{s}")).alias(f"{c}_{s}_per1k"), (F.col(f"{c}_{s}_count") > 0).cast("int").alias(f"{c}_{s}_binary"))]
    return rows.select(key, *[f"wordcount_{s}" for s in scopes], *made)


def term_frequencies(df: DataFrame, key: str, scope: str, terms: DataFrame) -> DataFrame:
    """For each term (category, term) how often it occurs and in how many rows; terms that never occur have zeros."""
    found = occurrences(df, key, [scope], terms).groupBy("category", "term", key).agg(F.count("*").alias("tl_n")).groupBy("category", "term").agg(F.sum("tl_n").alias("n"), F.count("*").alias("n_rows"))
    return terms.select("category", "term").distinct().join(found, ["category", "term"], "left").fillna(0, ["n", "n_rows"])
