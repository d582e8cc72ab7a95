"""Queries of phrase dictionaries: the first two and the first three words of every benchmark passage."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import tokens
from textloom.operators import dictionaries
from textloom.sources.tables import table

GROUPS = ["b0", "b1", "b2"]


def terms(spark, sf):
    words = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id") % 3).alias("category"), tokens(F.col("text"), "[a-z]+").alias("w"))
    return words.select("category", F.explode(F.array(*[F.array_join(F.slice("w", 1, n), "_") for n in (2, 3)])).alias("term")).filter("term <> ''").distinct()


def phrase_matrix(spark, sf):
    made = dictionaries.phrase_features(table(spark, sf, "documents"), "doc_id", ["text"], terms(spark, sf), GROUPS)
    return made.select("doc_id", "wordcount_text", *[f"{c}_text_count" for c in GROUPS], *[F.round(f"{c}_text_per1k", 6).alias(f"{c}_per1k") for c in GROUPS])


def phrase_frequency(spark, sf):
    return dictionaries.term_frequencies(table(spark, sf, "documents"), "doc_id", "text", terms(spark, sf))


#: One pattern for each category, the longest terms first; letters beyond ASCII are made word characters of ASCII.
PATTERNS_SQL = r"""
b AS (SELECT 'b' || item_id % 3 AS category, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
t AS (SELECT DISTINCT category, array_to_string(w[1:n], '_') AS term FROM b, range(2, 4) r(n) WHERE len(w) > 0),
g AS (SELECT category, '\b(?:' || string_agg(replace(term, '_', '[\s_-]+'), '|' ORDER BY length(term) DESC, term) || ')\b' AS pattern FROM t GROUP BY category),
d AS (SELECT doc_id, text, regexp_replace(lower(text), '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{No}\p{Nl}\p{Mc}\p{Me}]', 'x', 'g') AS plain FROM documents),
h AS (SELECT doc_id, category, regexp_extract_all(plain, pattern) AS hits FROM d, g)
"""
PHRASE_MATRIX_SQL = rf"""
WITH {PATTERNS_SQL}, n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM d)
SELECT n.doc_id, any_value(words)::INT AS wordcount_text, {", ".join(f"coalesce(sum(len(hits)) FILTER (WHERE category = '{c}'), 0)::BIGINT AS {c}_text_count" for c in GROUPS)},
{", ".join(f"round(CASE WHEN any_value(words) > 0 THEN 1000.0 * coalesce(sum(len(hits)) FILTER (WHERE category = '{c}'), 0) / any_value(words) END, 6) AS {c}_per1k" for c in GROUPS)}
FROM n LEFT JOIN h ON h.doc_id = n.doc_id GROUP BY n.doc_id
"""
PHRASE_FREQUENCY_SQL = rf"""
WITH {PATTERNS_SQL}, u AS (SELECT doc_id, category, regexp_replace(unnest(hits), '[\s_-]+', '_', 'g') AS term FROM h)
SELECT t.category, t.term, count(u.doc_id) AS n, count(DISTINCT u.doc_id) AS n_rows FROM t LEFT JOIN u ON u.category = t.category AND u.term = t.term GROUP BY t.category, t.term
"""

ALL = {"phrase_matrix": (phrase_matrix, PHRASE_MATRIX_SQL), "phrase_frequency": (phrase_frequency, PHRASE_FREQUENCY_SQL)}
