"""Queries over text: cleaning, sections, tokens, dictionary rates, collocations, concordances, markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import values as V
from textloom.operators import features, governance
from textloom.operators.stats import described
from textloom.operators.selection import exact_quantiles
from textloom.sources.tables import table

#: A small dictionary of our own: function words of the test documents by kind.
DICTIONARY = {"articles": ["the", "der", "die", "das", "les", "las", "los"], "links": ["and", "und", "et", "or"], "places": ["at", "from", "with", "dans", "von", "para"]}


def listed(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def counts_sql(extra: str = "") -> str:
    cats = ", ".join(f"len(list_filter(w, lambda t: t IN ({listed(t)}))) AS {c}_count" for c, t in DICTIONARY.items())
    return f"SELECT doc_id, lang, len(w) AS n_tokens, {cats} FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents){extra}"


def dictionary_counts(spark, sf):
    return features.token_counts(table(spark, sf, "documents"), "text", DICTIONARY, ["doc_id", "lang"])


def dictionary_rate_by_group(spark, sf):
    counts = dictionary_counts(spark, sf)
    rates = counts.select("lang", *[V.rate(F.col(f"{c}_count"), F.col("n_tokens")).alias(c) for c in DICTIONARY])
    long = rates.unpivot(["lang"], list(DICTIONARY), "category", "per1k")
    r = lambda c: F.round(c, 6)
    sums = long.groupBy("lang", "category").agg(F.count("per1k").alias("n"), r(F.avg("per1k")).alias("mean"), r(F.stddev_samp("per1k")).alias("sd"))
    medians = exact_quantiles(long, "per1k", [0.5], ["lang", "category"]).select("lang", "category", r(F.col("quantiles")[0]).alias("median"))
    return sums.join(medians, ["lang", "category"], "left")


DICTIONARY_RATE_SQL = f"""
WITH c AS ({counts_sql()}), l AS (
  {" UNION ALL ".join(f"SELECT lang, '{c}' AS category, CASE WHEN n_tokens > 0 THEN 1000.0 * {c}_count / n_tokens END AS per1k FROM c" for c in DICTIONARY)}
)
SELECT lang, category, count(per1k) AS n, round(avg(per1k), 6) AS mean, round(stddev_samp(per1k), 6) AS sd,
       round(quantile_cont(per1k, 0.5), 6) AS median
FROM l GROUP BY lang, category
"""


def squeezed_keys(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.content_key(F.col("text")).alias("record"), T.word_count(F.col("text")).alias("n_words"), F.length(T.squeezed(F.col("text"))).alias("n_squeezed"))


SQUEEZED_SQL = r"""
SELECT doc_id, sha256(s) AS record, len(list_filter(string_split(s, ' '), lambda w: w <> '')) AS n_words, length(s) AS n_squeezed
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
"""


def notes(spark, sf):
    """Records with labelled sections, made of the parts table; every seventh lacks its last but one."""
    p = table(spark, sf, "part")
    finish = F.when(F.col("p_partkey") % 7 == 0, F.lit(" ending: ")).otherwise(F.lit(" Finish: "))
    close = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" Comments: size "), F.col("p_size").cast("string"))).otherwise(F.lit(""))
    return p.select("p_partkey", F.concat(F.lit("Lead. Nose: "), "p_name", F.lit(" Mouth (neat): "), "p_brand", finish, "p_type", close).alias("note"))


NOTES_SQL = """SELECT p_partkey, 'Lead. Nose: ' || p_name || ' Mouth (neat): ' || p_brand
  || CASE WHEN p_partkey % 7 = 0 THEN ' ending: ' ELSE ' Finish: ' END || p_type
  || CASE WHEN p_partkey % 3 = 0 THEN ' Comments: size ' || p_size ELSE '' END AS note FROM part"""
HEADS = (("nose", r"\b(?i:Nose)\s*:"), ("mouth", r"\b(?i:Mouth\s*(?:\([^)]*\))?\s*:|Palate\s*:)"), ("finish", r"\bFinish\s*:"))


def sections(spark, sf):
    found = T.sections(F.col("note"), HEADS, ("comments", r"\bComments\s*:"))
    return notes(spark, sf).select("p_partkey", *[c.alias(n) for n, c in found.items()])


SECTIONS_SQL = rf"""
WITH n AS ({NOTES_SQL}), m AS (
  SELECT p_partkey, note, regexp_matches(note, 'Nose:.+Mouth \(neat\):.+Finish:.+') AS ok FROM n
)
SELECT p_partkey,
  CASE WHEN ok THEN trim(regexp_extract(note, 'Nose:(.*?)Mouth', 1)) ELSE '' END AS nose,
  CASE WHEN ok THEN trim(regexp_extract(note, '\(neat\):(.*?)Finish:', 1)) ELSE '' END AS mouth,
  CASE WHEN ok THEN trim(split_part(split_part(note, 'Finish:', 2), 'Comments:', 1)) ELSE '' END AS finish,
  CASE WHEN ok THEN trim(split_part(note, 'Comments:', 2)) ELSE '' END AS comments
FROM m
"""

ALIASES = (("small ", "little ", False), ("Brand#2", "House#2", False), (r"\bwidget\b", "gadget", True))


def aliases(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.rewritten(F.concat_ws(" ", "p_name", "p_brand"), ALIASES).alias("label"), T.without_prefix(F.concat_ws(" ", "p_name", "p_type"), F.col("p_name")).alias("rest"))


ALIASES_SQL = r"""
SELECT p_partkey, regexp_replace(replace(replace(p_name || ' ' || p_brand, 'small ', 'little '), 'Brand#2', 'House#2'), '\bwidget\b', 'gadget', 'g') AS label,
       trim(substr(p_name || ' ' || p_type, length(p_name) + 1)) AS rest
FROM part
"""


def redacted(spark, sf):
    """Values leaked into text are deleted, also inside contexts until none is left."""
    value = r"\b\d{1,3}\b(?!\s*(?:%|years?\b))"
    redact = T.fixpoint_redactor((r"\bsize\s*\d+",), (rf"\b(?:score|rated)\b[^.!?\n]{{0,45}}?{value}",), value)
    n = notes(spark, sf).withColumn("note", F.concat("note", F.lit(" Rated 88, or 91 at 46 %. The score: 90 / 92 after 12 years")))
    return n.select("p_partkey", redact("note").alias("note"))


REDACTED_SQL = f"SELECT p_partkey, trim(regexp_replace(regexp_replace(note, 'size [0-9]+', ''), ' +', ' ', 'g')) || ' Rated , or at 46 %. The score: / after 12 years' AS note FROM ({NOTES_SQL}) n"


def titles(spark, sf):
    """Heads of five shapes: a strength after an essay, a plain label, a label before a number, an open bracket, none."""
    name, size, k = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 5
    shapes = [
        F.concat(F.lit("PREVIEW An essay. The "), name, F.lit(" ("), size, F.lit("%, cask (oak (old)) #1) and (more) prose")),
        F.concat(name, F.lit("  (old one) The rest (or not)")),
        F.concat(name, F.lit(" (old one) 77")),
        F.concat(F.lit("preview "), name, F.lit(" ("), size, F.lit(" %, never (closed)")),
        name,
    ]
    head = F.coalesce(*[F.when(k == n, x) for n, x in enumerate(shapes)])
    return table(spark, sf, "part").select("p_partkey", T.title_of(head).alias("t")).select("p_partkey", "t.*")


TITLES_SQL = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'The ' || p_name || ' (' || p_size || '%, cask (oak (old)) #1)' WHEN 3 THEN p_name || ' (' || p_size || ' %, never (closed)'
  WHEN 4 THEN p_name ELSE p_name || ' (old one)' END AS title, p_partkey % 5 >= 2 AS doubtful FROM part"""


def url_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_key(F.col("url")).alias("link"), T.url_key(F.col("url"), True).alias("loose"))


URL_SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h,
                  regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages)
SELECT page_id, s || '://' || h || p AS link, s || '://' || h || lower(p) AS loose FROM p
"""


def top_tokens(spark, sf):
    words = table(spark, sf, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_langs")).orderBy(F.desc("n"), "term").limit(50)


TOP_TOKENS_SQL = "SELECT term, count(*) AS n, count(DISTINCT lang) AS n_langs FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z_]+')) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 50"


def collocations(spark, sf):
    found = features.collocations(table(spark, sf, "documents"), "text", 20, 0.2)
    return found.select("a", "b", "n_ab", F.round("npmi", 6).alias("npmi"))


COLLOCATIONS_SQL = """
WITH d AS (SELECT regexp_extract_all(lower(text), '[a-z_]+') AS w FROM documents),
s AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY t),
p AS (SELECT a, b, count(*) AS n_ab FROM (SELECT unnest(list_slice(w, 1, len(w) - 1)) AS a, unnest(list_slice(w, 2, len(w))) AS b FROM d WHERE len(w) > 1) GROUP BY a, b HAVING count(*) >= 20),
q AS (SELECT p.*, sa.n AS n_a, sb.n AS n_b, (SELECT sum(n) FROM s)::DOUBLE AS m FROM p JOIN s sa ON sa.t = a JOIN s sb ON sb.t = b),
r AS (SELECT a, b, n_ab, ln((n_ab / m) / ((n_a / m) * (n_b / m))) / -ln(n_ab / m) AS npmi FROM q)
SELECT a, b, n_ab, round(npmi, 6) AS npmi FROM r WHERE npmi >= 0.2
"""


def enrichment(spark, sf):
    d = table(spark, sf, "documents").withColumn("in_source", F.col("source") == "src0")
    found = features.term_enrichment(d, "text", "in_source", 60)
    return found.select("term", "n", "n_in", "df", F.round("anchor_share", 6).alias("anchor_share"), F.round("enrichment", 6).alias("enrichment"))


ENRICHMENT_SQL = """
WITH d AS (SELECT doc_id AS rid, source = 'src0' AS x, regexp_extract_all(lower(text), '[a-z_]+') AS w FROM documents),
r AS (SELECT rid, x, t, count(*) AS k FROM (SELECT rid, x, unnest(w) AS t FROM d) GROUP BY rid, x, t),
c AS (SELECT t AS term, sum(k)::BIGINT AS total, coalesce(sum(k) FILTER (WHERE x), 0)::BIGINT AS n_in, count(*) AS df, avg(x::INT) AS anchor_share FROM r GROUP BY t),
e AS (SELECT *, row_number() OVER (ORDER BY total DESC, term) AS place FROM c),
z AS (SELECT count(*) FILTER (WHERE x) AS a, count(*) FILTER (WHERE NOT x) AS b FROM d)
SELECT term, total AS n, n_in, df, round(anchor_share, 6) AS anchor_share, round((n_in / a) / ((total - n_in) / b + 0.001), 6) AS enrichment FROM e, z WHERE place <= 60
"""


def concordance(spark, sf):
    terms = spark.createDataFrame([("idiot",), ("license",), ("über",), ("apache",)], "term string")
    used = governance.usage(table(spark, sf, "documents"), "doc_id", "text", terms)
    return used.select("term", "frequency", F.array_join("snippets", " || ").alias("snippets"))


CONCORDANCE_SQL = r"""
WITH t AS (SELECT unnest(['idiot', 'license', 'über', 'apache']) AS term),
h AS (SELECT term, doc_id, lower(text) AS low, length(regexp_extract(lower(text), '(?s)^(|.*?[^a-z])' || term || '([^a-z]|$)', 1)) + 1 AS spot
      FROM t JOIN documents d ON regexp_matches(lower(text), '(^|[^a-z])' || term || '([^a-z]|$)')),
s AS (SELECT term, doc_id, trim(regexp_replace(substr(low, greatest(1, spot - 85)::BIGINT, (spot + length(term) + 85 - greatest(1, spot - 85))::BIGINT), '\s+', ' ', 'g')) AS snippet, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS k FROM h)
SELECT term, count(*) AS frequency, coalesce(max(snippet) FILTER (WHERE k = 1), '') || ' || ' || coalesce(max(snippet) FILTER (WHERE k = 2), '') || ' || ' || coalesce(max(snippet) FILTER (WHERE k = 3), '') AS snippets FROM s GROUP BY term
"""

MARKERS = {"digits": "[0-9]{3}", "mail": "[a-z]@[a-z]", "license": "(?i)licen[sc]e"}


def markers(spark, sf):
    d = table(spark, sf, "documents")
    return governance.marker_counts({"source": d, "clean": d.withColumn("text", F.regexp_replace("text", "[0-9]", ""))}, ["text"], MARKERS)


MARKERS_SQL = " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, 'text' AS scope, '{m}' AS marker, count(*) FILTER (WHERE regexp_matches({body}, '{p}')) AS n FROM documents"
    for stage, body in (("source", "text"), ("clean", "regexp_replace(text, '[0-9]', '', 'g')"))
    for m, p in MARKERS.items()
)


def summary(spark, sf):
    return governance.summary(table(spark, sf, "documents"), "source", "n_chars", "lang", ["text", "source"])


SUMMARY_SQL = """
SELECT count(*) AS n, count(DISTINCT source) AS n_keys, round(avg(n_chars), 3) AS score_mean, round(quantile_cont(n_chars, 0.5), 3) AS score_median,
  round(stddev_samp(n_chars), 3) AS score_sd, min(n_chars) AS score_min, max(n_chars) AS score_max, min(lang) AS year_min, max(lang) AS year_max,
  count(*) FILTER (WHERE trim(text) <> '') AS n_text, count(*) FILTER (WHERE trim(source) <> '') AS n_source FROM documents
"""


def feature_matrix(spark, sf):
    """Pattern counts, rates and indicators of all scopes; described over the rows."""
    d = table(spark, sf, "documents").withColumn("plain", F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    made = features.with_features(d, ["text", "plain"], DICTIONARY, ["doc_id"])
    return described(made, [c for c in made.columns if c.endswith("_per1k")])


def matrix_cell(category: str, terms: list[str], scope: str) -> str:
    """The count from tokens between characters that are no word characters, as a word boundary has it."""
    per = f"CASE WHEN n_{scope} > 0 THEN 1000.0 * len(list_filter(t_{scope}, lambda t: t IN ({listed(terms)}))) / n_{scope} END"
    return f"SELECT '{category}_{scope}_per1k' AS variable, {per} AS x FROM w"


MATRIX_SQL = rf"""
WITH d AS (SELECT lower(text) AS text, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS plain FROM documents),
w AS (SELECT {", ".join(rf"regexp_extract_all({s}, '[\p{{L}}\p{{N}}\p{{Mn}}_]+') AS t_{s}, len(list_filter(regexp_split_to_array({s}, '\s+'), lambda x: x <> '')) AS n_{s}" for s in ("text", "plain"))} FROM d),
l AS ({" UNION ALL ".join(matrix_cell(c, t, s) for s in ("text", "plain") for c, t in DICTIONARY.items())})
SELECT variable, count(x) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_samp(x), 6) AS sd, min(x) AS min, max(x) AS max FROM l GROUP BY variable
"""


def sentiments(spark, sf):
    score = features.sentiment({"idiot": -2.5, "stupid": -2.0, "worthless": -1.8, "the": 0.1, "lich": 0.4})
    return table(spark, sf, "documents").select("doc_id", score("text").alias("s")).select("doc_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("compound", "pos", "neg", "neu")])


SENTIMENT_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+') AS w FROM documents),
v AS (SELECT doc_id, w, list_transform(w, lambda x: CASE x WHEN 'idiot' THEN -2.5 WHEN 'stupid' THEN -2.0 WHEN 'worthless' THEN -1.8 WHEN 'the' THEN 0.1 WHEN 'lich' THEN 0.4 ELSE 0.0 END::DOUBLE) AS v FROM w),
b AS (SELECT doc_id, w, v, list_transform(range(1, len(w) + 1), lambda k: CASE WHEN v[k] = 0 THEN 0.0 ELSE
  (v[k] + sign(v[k]) * CASE WHEN k > 1 THEN CASE w[k - 1] WHEN 'very' THEN 0.3 WHEN 'really' THEN 0.3 WHEN 'extremely' THEN 0.3 WHEN 'slightly' THEN -0.3 ELSE 0.0 END ELSE 0.0 END)
  * CASE WHEN list_has_any(w[greatest(1, k - 3):k - 1], ['not', 'no', 'never', 'without']) THEN -0.74 ELSE 1 END END::DOUBLE) AS f FROM v),
t AS (SELECT doc_id, coalesce(list_sum(f), 0) AS s, coalesce(list_sum(list_transform(list_filter(f, lambda x: x > 0), lambda x: x + 1)), 0) AS p,
  coalesce(list_sum(list_transform(list_filter(f, lambda x: x < 0), lambda x: 1 - x)), 0) AS n, len(list_filter(f, lambda x: x = 0)) AS z FROM b)
SELECT doc_id, round(s / sqrt(s * s + 15), 6) AS compound, round(p / greatest(p + n + z, CASE WHEN p + n + z = 0 THEN 1 ELSE 0 END), 6) AS pos,
  round(n / greatest(p + n + z, CASE WHEN p + n + z = 0 THEN 1 ELSE 0 END), 6) AS neg, round(z / greatest(p + n + z, CASE WHEN p + n + z = 0 THEN 1 ELSE 0 END), 6) AS neu FROM t
"""


def lemmas(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text"), "[a-z]+"))).alias("term")).distinct()
    return words.select("term", T.lemma(F.col("term")).alias("lemma"))


LEMMAS_SQL = r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
SELECT term, CASE
  WHEN length(term) < 3 THEN term
  WHEN term IN ('men','women','children','feet','teeth','mice','geese','leaves','loaves','knives','lives') THEN
    CASE term WHEN 'men' THEN 'man' WHEN 'women' THEN 'woman' WHEN 'children' THEN 'child' WHEN 'feet' THEN 'foot' WHEN 'teeth' THEN 'tooth' WHEN 'mice' THEN 'mouse'
      WHEN 'geese' THEN 'goose' WHEN 'leaves' THEN 'leaf' WHEN 'loaves' THEN 'loaf' WHEN 'knives' THEN 'knife' ELSE 'life' END
  WHEN regexp_matches(term, 'ies$') AND length(term) > 4 THEN regexp_replace(term, 'ies$', 'y')
  WHEN regexp_matches(term, '(ss|sh|ch|x|z)es$') THEN regexp_replace(term, 'es$', '')
  WHEN regexp_matches(term, '(ss|us|is)$') THEN term
  WHEN regexp_matches(term, '^[a-z]{2,}s$') THEN regexp_replace(term, 's$', '')
  ELSE term END AS lemma FROM w
"""

ALL = {
    "dictionary_rate_by_group": (dictionary_rate_by_group, DICTIONARY_RATE_SQL),
    "dictionary_counts": (dictionary_counts, counts_sql()),
    "squeezed_keys": (squeezed_keys, SQUEEZED_SQL),
    "sections": (sections, SECTIONS_SQL),
    "aliases": (aliases, ALIASES_SQL),
    "redacted": (redacted, REDACTED_SQL),
    "titles": (titles, TITLES_SQL),
    "url_keys": (url_keys, URL_SQL),
    "top_tokens": (top_tokens, TOP_TOKENS_SQL),
    "collocations": (collocations, COLLOCATIONS_SQL),
    "term_enrichment": (enrichment, ENRICHMENT_SQL),
    "concordance": (concordance, CONCORDANCE_SQL),
    "marker_counts": (markers, MARKERS_SQL),
    "corpus_summary": (summary, SUMMARY_SQL),
    "feature_matrix": (feature_matrix, MATRIX_SQL),
    "sentiment": (sentiments, SENTIMENT_SQL),
    "lemmas": (lemmas, LEMMAS_SQL),
}
