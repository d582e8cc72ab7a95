"""Queries of row tests, recodings and list building."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import predicates as P
from textloom.operators.stats import average_rank
from textloom.plans.texts import NOTES_SQL, notes
from textloom.sources.tables import table


def gates(spark, sf):
    ok = P.record_like(F.col("note"), [("Nose:",), ("Mouth", "Palate:"), ("Finish:",)], [("widget", "small"), ("economy",)], 30)
    return notes(spark, sf).select("p_partkey", ok.alias("record_like"), P.starts_with_any(F.col("note"), ("lead. nose: red", "lead. nose: blue")).alias("banner"))


GATES_SQL = f"""WITH n AS ({NOTES_SQL}) SELECT p_partkey, contains(note, 'Finish:') AND length(note) >= 30 AND NOT (contains(lower(note), 'widget') AND contains(lower(note), 'small'))
  AND NOT contains(lower(note), 'economy') AS record_like, starts_with(lower(note), 'lead. nose: red') OR starts_with(lower(note), 'lead. nose: blue') AS banner FROM n"""


def cued(spark, sf):
    p = table(spark, sf, "part")
    cue = P.cues(F.concat_ws(" ", "p_name", "p_type"), [("ring", r"\bring\b"), ("tool", r"\b(widget|anvil)\b")])
    return p.select("p_partkey", cue.alias("cue"), P.recoded(F.col("p_type"), {"ECONOMY": "cheap", "PROMO": "cheap"}, "other").alias("class"), P.whole_number(F.regexp_extract("p_brand", "#(.*)", 1)).alias("numbered"))


CUED_SQL = r"SELECT p_partkey, CASE WHEN regexp_matches(p_name || ' ' || p_type, '(?i)\bring\b') THEN 'ring' WHEN regexp_matches(p_name || ' ' || p_type, '(?i)\b(widget|anvil)\b') THEN 'tool' END AS cue, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'cheap' ELSE 'other' END AS class, regexp_matches(split_part(p_brand, '#', 2), '^[0-9]+$') AS numbered FROM part"


def above(spark, sf):
    return P.above_quantile(table(spark, sf, "part"), {"p_size": 0.75, "p_retailprice": 0.5}).groupBy("above").agg(F.count("*").alias("n"))


def year_links(spark, sf):
    links = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("http://a.org/archive"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.date_format("o_orderdate", "yy")), F.lit("-1.html")).alias("url"))
    kind = P.page_kind(F.col("url"), {"unknown": ("archivex-1.html",), "first": ("archive95-1.html",)})
    return links.filter(P.in_years(F.col("url"), 1995, 1997)).groupBy(P.link_year(F.col("url")).alias("year"), kind.alias("kind")).agg(F.count("*").alias("n"))


YEAR_SQL = "SELECT year(o_orderdate)::INT AS year, CASE WHEN year(o_orderdate) = 1995 THEN 'first' ELSE 'other' END AS kind, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 AND year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY 1, 2"


def pairs(spark, sf):
    p = table(spark, sf, "part").select(F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b")).distinct()
    curated = spark.createDataFrame([("widget_red",), ("small_ring",)], "phrase string")
    return P.pair_filter(p, curated, ["red", "blue", "ring"], ["anvil"])


PAIRS_SQL = "WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT a, b, CASE WHEN list_sort([a, b]) IN (['red', 'widget'], ['ring', 'small']) THEN 'curated' WHEN a IN ('red', 'blue', 'ring') AND b IN ('red', 'blue', 'ring') THEN 'stopwords' WHEN a = 'anvil' OR b = 'anvil' THEN 'filler' END AS dropped_because FROM p"


def unjoined(spark, sf):
    return P.left_unjoined(table(spark, sf, "part"), "p_name", ["red_widget", "small_ring", "no_such"])


UNJOINED_SQL = " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) FILTER (WHERE contains(p_name, '{p.replace('_', ' ')}')) AS n_left FROM part" for p in ("red_widget", "small_ring", "no_such"))


def best(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return P.best_category(o, "o_orderpriority", "o_orderstatus", "n")


def final(spark, sf):
    p = table(spark, sf, "part")
    n = p.groupBy(F.col("p_name").alias("term")).agg(F.count("*").alias("frequency"))
    resolved = p.filter("p_size = 50").groupBy(F.col("p_name").alias("term")).agg(F.when(F.max("p_partkey") % 2 == 0, "wood").otherwise("fruit").alias("category"))
    return P.final_terms(n, p.filter("p_size = 1").select(F.col("p_name").alias("term")).distinct(), resolved, "wood", 35)


FINAL_SQL = """WITH r AS (SELECT p_name AS term, max(p_partkey) % 2 = 0 AS wood FROM part WHERE p_size = 50 GROUP BY 1)
SELECT term FROM (SELECT p_name AS term FROM part GROUP BY 1 HAVING count(*) >= 35 UNION SELECT p_name FROM part WHERE p_size = 1 UNION SELECT term FROM r WHERE wood)
WHERE term NOT IN (SELECT term FROM r WHERE NOT wood)"""


def ordered_lists(spark, sf):
    p = table(spark, sf, "part")
    a, b = p.filter("p_size > 45").groupBy("p_name").agg(F.min("p_partkey").alias("at")), p.groupBy("p_name").agg(F.min("p_partkey").alias("at"))
    return P.in_order([a, b], "p_name", "at").select("p_name", "place.list", "place.at")


def thin(spark, sf):
    o = table(spark, sf, "orders")
    return P.thin_pages(o.select(F.col("o_custkey").alias("url")), table(spark, sf, "customer").select(F.col("c_custkey").alias("url")))


def effects(spark, sf):
    return P.simple_effect(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", ["l_quantity", "l_tax"])


EFFECTS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS measure, round((avg({c}) FILTER (WHERE l_returnflag = 'R') - avg({c}) FILTER (WHERE l_returnflag <> 'R')) / sqrt((var_samp({c}) FILTER (WHERE l_returnflag = 'R') + var_samp({c}) FILTER (WHERE l_returnflag <> 'R')) / 2), 6) AS d FROM lineitem" for c in ("l_quantity", "l_tax"))


def widest(spark, sf):
    return P.widest_mean(table(spark, sf, "events"), "event_type", "user_id", "value").select("event_type", "user_id", F.round("mean", 6).alias("mean"))


def complete(spark, sf):
    t = table(spark, sf, "labels")
    return P.complete(table(spark, sf, "documents").join(t, "doc_id", "left"), ["quality", "n_chars"]).groupBy("lang").agg(F.count("*").alias("n"))


def average_ranks(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", average_rank("c_nationkey", ["c_mktsegment"]).alias("rank"))


def token_shares(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("value"))
    return P.share_of_total(e, "value").select("event_type", F.round("share", 6).alias("share"))


ALL = {
    "structure_gates": (gates, GATES_SQL),
    "cues": (cued, CUED_SQL),
    "above_quantile": (above, "WITH q AS (SELECT quantile_cont(p_size, 0.75) AS a, quantile_cont(p_retailprice, 0.5) AS b FROM part) SELECT p_size > a AND p_retailprice > b AS above, count(*) AS n FROM part, q GROUP BY 1"),
    "year_links": (year_links, YEAR_SQL),
    "pair_filter": (pairs, PAIRS_SQL),
    "left_unjoined": (unjoined, UNJOINED_SQL),
    "best_category": (best, "SELECT o_orderpriority, o_orderstatus, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) AS k FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE k = 1"),
    "final_terms": (final, FINAL_SQL),
    "ordered_lists": (ordered_lists, "SELECT p_name, CASE WHEN max(p_size) > 45 THEN 0 ELSE 1 END AS list, coalesce(min(p_partkey) FILTER (WHERE p_size > 45), min(p_partkey)) AS at FROM part GROUP BY p_name"),
    "thin_pages": (thin, "SELECT c_custkey AS url, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < 2"),
    "simple_effects": (effects, EFFECTS_SQL),
    "widest_mean": (widest, "SELECT event_type, user_id, round(mean, 6) AS mean FROM (SELECT event_type, user_id, avg(value) AS mean, row_number() OVER (PARTITION BY event_type ORDER BY avg(value) DESC, user_id) AS k FROM events GROUP BY 1, 2) WHERE k = 1"),
    "complete_cases": (complete, "SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality > 0 AND n_chars > 0 GROUP BY lang"),
    "average_ranks": (average_ranks, "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS rank FROM customer"),
    "shares_of_total": (token_shares, "SELECT event_type, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY 1"),
}
