"""Dictionary features: counts, rates and indicators of term categories in text scopes, and sentiment."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import blank, category_pattern, tokens, word_count
from textloom.functions.values import rate


def short_names(dictionary: dict[str, dict]) -> dict[str, list[str]]:
    """Terms by short name; a missing or repeated short name is an error."""
    out: dict[str, list[str]] = {}
    for name, entry in dictionary.items():
        short = entry.get("short_name")
        if not short or short in out:
            raise ValueError(f"short name of {name} is missing or repeated")
        out[short] = list(entry["terms"])
    return out


def with_features(df: DataFrame, scopes: list[str], categories: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """For each scope a word count, and for each category in it a count, a rate per 1000 words and an indicator.

    One projection: word counts and pattern counts first, so that each text is matched once for each category."""
    first = df.select(*keep, *[word_count(F.col(s)).alias(f"wordcount_{s}") for s in scopes], *[F.regexp_count(F.lower(blank(F.col(s))), F.lit(category_pattern(t))).alias(f"{c}_{s}_count") for s in scopes for c, t in categories.items()])
    made = [x for s in scopes for c in categories for x in (F.col(f"{c}_{s}_count"), rate(F.col(f"{c}_{s}_count"), F.col(f"wordcount_{s}")).alias(f"{c}_{s}_per1k"), (F.col(f"{c}_{s}_count") > 0).cast("int").alias(f"{c}_{s}_binary"))]
    return first.select(*keep, *[f"wordcount_{s}" for s in scopes], *made)


def token_counts(df: DataFrame, text: str, categories: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Counts of single-word terms by tokens: one pass over the tokens, however many categories."""
    words = df.select(*keep, tokens(F.col(text), "[a-z]+").alias("tl_w"))

    def listed(terms):
        return F.size(F.filter("tl_w", lambda w: w.isin(terms)))

    return words.select(*keep, F.size("tl_w").alias("n_tokens"), *[listed(t).alias(f"{c}_count") for c, t in categories.items()])


def sentiment(lexicon: dict[str, float], negations: frozenset[str] = frozenset({"not", "no", "never", "without"}), boosters: dict[str, float] | None = None):
    """A column function: compound, pos, neg and neu of a text from a (term, valence) table. The lexicon is the caller's."""
    raised = boosters or {"very": 0.3, "really": 0.3, "extremely": 0.3, "slightly": -0.3}

    def one(text: str | None) -> tuple[float, float, float, float]:
        words = re.findall(r"[\w']+", (text or "").lower())
        found = []
        for k, w in enumerate(words):
            v = lexicon.get(w, 0.0)
            if v:
                v += (1 if v > 0 else -1) * sum(raised.get(p, 0.0) for p in words[max(0, k - 1) : k])
                v *= -0.74 if negations & {*words[max(0, k - 3) : k]} else 1
            found.append(v)
        total = sum(found)
        pos, neg, neu = sum(v + 1 for v in found if v > 0), sum(1 - v for v in found if v < 0), sum(not v for v in found)
        whole = pos + neg + neu or 1
        return total / (total * total + 15) ** 0.5, pos / whole, neg / whole, neu / whole

    @F.pandas_udf("compound double, pos double, neg double, neu double")
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["compound", "pos", "neg", "neu"])

    return score


def collocations(df: DataFrame, text: str, least: int = 20, threshold: float = 0.2, connectors: tuple[str, ...] = ()) -> DataFrame:
    """Word pairs by normalised pointwise mutual information, from plain adjacent pairs (no greedy joining)."""
    words = df.select(tokens(F.col(text)).alias("w"))
    words = words.select(F.filter("w", lambda x: ~x.isin(*connectors)).alias("w")) if connectors else words
    single = words.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    n = F.sum("n")
    total = single.agg(n.alias("total"))
    pairs = words.filter(F.size("w") > 1).select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= least)
    a, b = single.select(F.col("term").alias("a"), F.col("n").alias("n_a")), single.select(F.col("term").alias("b"), F.col("n").alias("n_b"))
    rows = pairs.join(a, "a").join(b, "b").crossJoin(F.broadcast(total))
    p = lambda c: F.col(c) / F.col("total")
    score = F.log(p("n_ab") / (p("n_a") * p("n_b"))) / -F.log(p("n_ab"))
    return rows.withColumn("npmi", score).filter(F.col("npmi") >= threshold).select("a", "b", "n_ab", "npmi")


def term_enrichment(df: DataFrame, text: str, anchor: str, k: int = 100) -> DataFrame:
    """The ``k`` most frequent tokens, with their counts in anchor rows and others, the ratio of their rates, and the
    share of their rows that are anchors."""
    rows = df.withColumn("row", F.monotonically_increasing_id()).select("row", F.coalesce(F.col(anchor), F.lit(False)).alias("in"), F.explode(tokens(F.col(text))).alias("term"))
    sides = df.agg(F.count_if(F.coalesce(F.col(anchor), F.lit(False))).alias("rows_in"), F.count_if(~F.coalesce(F.col(anchor), F.lit(False))).alias("rows_out"))
    per_row = rows.groupBy("row", "in", "term").agg(F.count("*").alias("n"))
    counts = per_row.groupBy("term").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("in"), F.col("n")).otherwise(0)).alias("n_in"), F.count("*").alias("df"), F.avg(F.col("in").cast("double")).alias("anchor_share"))
    top = counts.orderBy(F.desc("n"), "term").limit(k).crossJoin(F.broadcast(sides))
    return top.select("term", "n", "n_in", "df", "anchor_share", ((F.col("n_in") / F.col("rows_in")) / ((F.col("n") - F.col("n_in")) / F.col("rows_out") + 0.001)).alias("enrichment"))


def joined_pairs(words: Column, pairs: Column, connectors: tuple[str, ...] = ()) -> Column:
    """Token lists with listed pairs (an array of ``a b``) joined by underscores, from the left and without overlap; up to
    two connectors may stand between the words of a pair, and become part of it."""
    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("done"), F.lit(None).cast("string").alias("last"), F.expr("CAST(array() AS array<string>)").alias("between"))
    flushed = lambda s: F.concat(s["done"], F.when(s["last"].isNull(), F.array().cast("array<string>")).otherwise(F.array(s["last"])), s["between"])
    none = F.expr("CAST(array() AS array<string>)")

    def step(s, w):
        hit = s["last"].isNotNull() & F.array_contains(pairs, F.concat_ws(" ", s["last"], w))
        bridge = w.isin(*connectors) & s["last"].isNotNull() & (F.size(s["between"]) < 2) if connectors else F.lit(False)
        phrase = F.array_join(F.concat(F.array(s["last"]), s["between"], F.array(w)), "_")
        return (
            F.when(hit, F.struct(F.concat(s["done"], F.array(phrase)).alias("done"), F.lit(None).cast("string").alias("last"), none.alias("between")))
            .when(bridge, F.struct(s["done"].alias("done"), s["last"].alias("last"), F.concat(s["between"], F.array(w)).alias("between")))
            .otherwise(F.struct(flushed(s).alias("done"), w.alias("last"), none.alias("between")))
        )

    return F.aggregate(words, start, step, flushed)
