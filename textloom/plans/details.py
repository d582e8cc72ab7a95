"""Queries of the smaller operators: heads and bodies of records, link and date details, worksheets, splits, effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import values as V
from textloom.operators import features, governance, html, linkage, models, predicates, stats, vectors
from textloom.operators import relational as R
from textloom.plans.texts import NOTES_SQL, notes
from textloom.operators.selection import exact_quantiles
from textloom.sources.tables import table

MARKERS = ("Nose:", "Lead.")


def heads(spark, sf):
    """The first marker's place and what stands before it, in the order of the list."""
    n = F.col("note")
    return notes(spark, sf).select("p_partkey", T.marker_position(n, ("Comments:", "Finish:")).alias("place"), T.before_marker(n, ("Comments:", "Finish:")).alias("head"))


HEADS_SQL = f"""WITH n AS (SELECT p_partkey, note, CASE WHEN contains(note, 'Comments:') THEN strpos(note, 'Comments:') WHEN contains(note, 'Finish:') THEN strpos(note, 'Finish:') END AS place FROM ({NOTES_SQL}))
SELECT p_partkey, place::INT AS place, trim(CASE WHEN place IS NULL THEN note ELSE left(note, place - 1) END) AS head FROM n"""


def rebuilt(spark, sf):
    whole = F.concat(F.lit("PREVIEW  "), "p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit("%)  an intro. "), F.when(F.col("p_partkey") % 4 == 0, "Body").otherwise("Colour"), F.lit(": "), "p_type")
    p = table(spark, sf, "part").withColumns({"whole": whole, "title": F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit("%)"))})
    return p.select("p_partkey", T.rebuilt(F.col("whole"), F.col("title"), ("Colour:", "Color:")).alias("text"), T.number_after(F.col("whole"), r"\((\d+)%").alias("number"))


REBUILT_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'PREVIEW ' ELSE '' END || p_name || ' (' || p_size || '%) an intro. ' || CASE WHEN p_partkey % 4 = 0 THEN 'Body' ELSE 'Colour' END || ': ' || p_type AS text, p_size::INT AS number FROM part"


def suffixes(spark, sf):
    name = F.concat("p_name", F.lit("-Glen"), F.when(F.col("p_partkey") % 2 == 0, " old").otherwise("more"))
    return table(spark, sf, "part").select("p_partkey", T.after_letter_suffix(name, "glen").alias("name"), T.joined_phrases(F.col("p_name"), ["red_widget", "small_ring", "ring"], [("blue", "azure")]).alias("joined"))


SUFFIXES_SQL = r"SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' old' ELSE '-Glenmore' END AS name, regexp_replace(regexp_replace(replace(p_name, 'blue', 'azure'), '\bred\s+widgets?\b', 'red_widget', 'g'), '\bsmall\s+rings?\b', 'small_ring', 'g') AS joined FROM part"


def snippets(spark, sf):
    lead = F.lower(F.left(T.squeezed(F.col("text")), F.lit(80)))
    d = table(spark, sf, "documents")
    return d.select("doc_id", lead.alias("lead"), F.contains(F.lower(T.squeezed(F.col("text"))), lead).alias("there"), T.excerpt(F.col("text"), ["und", "and"], 2, 4).alias("words"))


SNIPPETS_SQL = r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT *, list_position(list_transform(w, lambda x: lower(regexp_replace(x, '^[^a-zA-Z0-9_]+|[^a-zA-Z0-9_]+$', '', 'g')) IN ('und', 'and')), true) AS k FROM d)
SELECT doc_id, lower(left(s, 80)) AS lead, true AS there, array_to_string(w[greatest(1, coalesce(k, 0) - 2):greatest(1, coalesce(k, 0) - 2) + 3], ' ') AS words FROM p"""


def entities(spark, sf):
    raw = F.concat(F.lit("&lt;b&gt; "), "p_name", F.lit(" &amp; caf&eacute; &#8364;"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", T.unescaped(raw).alias("plain"), T.match_key(F.concat(F.lit("The  "), "p_name", F.lit(" 46 % ABV \u2019x\u2019!"))).alias("key"))


def similar(spark, sf):
    """Ratios of names with themselves, with a part, with nothing alike, and of an empty name."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"))
    other = F.when(F.col("p_partkey") % 4 == 0, F.col("a")).when(F.col("p_partkey") % 4 == 1, F.concat("a", "a")).when(F.col("p_partkey") % 4 == 2, F.lit("0123")).otherwise(F.lit(""))
    return p.withColumn("b", other).select("p_partkey", F.round(linkage.similarity("b", "a"), 6).alias("ratio"))


SIMILAR_SQL = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN round(2 / 3.0, 6) ELSE 0.0 END::DOUBLE AS ratio FROM part"


def consistent(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    both = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    flag = V.same_day(F.when(F.col("l_quantity") > 10, day("l_shipdate")), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd"))
    return both.groupBy(flag.alias("same")).agg(F.count("*").alias("n"))


def cells(spark, sf):
    """Coefficients as text, with stars by their p."""
    p = F.element_at(F.array(F.lit(0.0005), F.lit(0.005), F.lit(0.02), F.lit(0.2)), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", predicates.cell(F.col("p_size") / 8, F.lit(0.25), p, 3).alias("cell"))


CELLS_SQL = "SELECT p_partkey, printf('%.3f', p_size / 8.0) || CASE p_size % 4 WHEN 0 THEN '***' WHEN 1 THEN '**' WHEN 2 THEN '*' ELSE '' END || ' (0.250)' AS cell FROM part"


def dots(spark, sf):
    e = table(spark, sf, "embeddings")
    first = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("axis")))
    return e.crossJoin(first).select("vec_id", F.round(vectors.raw_dot(F.col("embedding"), F.col("axis")), 5).alias("dot"))


DOTS_SQL = "SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 5) AS dot FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) a"


def counted(spark, sf):
    """Occurrences of a category's terms, the longest first, whatever joins their words."""
    pattern = T.category_pattern(["small_ring", "ring", "red_widget"])
    text = F.concat_ws("-", F.regexp_replace("p_name", " ", "_"), "p_name")
    return table(spark, sf, "part").groupBy(F.regexp_count(text, F.lit(pattern)).cast("long").alias("hits")).agg(F.count("*").alias("n"))


def largest(spark, sf):
    """The name of the largest column, the first of equal ones, and the spread."""
    columns = ["a", "b", "c"]
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5).alias("a"), (F.col("p_partkey") % 5).alias("b"), F.lit(2).alias("c"))
    return p.select("p_partkey", V.first_of_largest(columns).alias("top"), (F.greatest(*columns) - F.least(*columns)).cast("long").alias("spread"))


LARGEST_SQL = "WITH p AS (SELECT p_partkey, p_size % 5 AS a, p_partkey % 5 AS b, 2 AS c FROM part) SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS top, (greatest(a, b, c) - least(a, b, c))::BIGINT AS spread FROM p"


def by_category(spark, sf):
    t = table(spark, sf, "part")
    medians = exact_quantiles(t, "p_size", [0.5], ["p_brand"]).select("p_brand", F.col("quantiles")[0].alias("median"))
    p = t.groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high")).join(medians, "p_brand").select("p_brand", "low", "median", "high")
    return R.top_k(p, [F.desc("median"), F.col("p_brand")], 10, rank="place")


def firsts(spark, sf):
    one = R.first_by(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return R.wide(one, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], F.first("o_orderkey"))


FIRSTS_SQL = """WITH f AS (SELECT o_custkey, o_orderstatus, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1, 2)
SELECT o_custkey, coalesce(max(k) FILTER (WHERE o_orderstatus = 'F'), 0) AS "F", coalesce(max(k) FILTER (WHERE o_orderstatus = 'O'), 0) AS "O", coalesce(max(k) FILTER (WHERE o_orderstatus = 'P'), 0) AS "P" FROM f GROUP BY 1"""


def canonical(spark, sf):
    """Plurals go where their singular is there, terms that are excluded go, and the rest says why it is ambiguous."""
    word = lambda k: F.split("p_name", " ")[k]
    p = table(spark, sf, "part")
    prior = p.select(F.concat(word(0), F.lit("s")).alias("term"), F.lit("a").alias("prior")).distinct()
    more = p.filter("p_size > 10").select(word(0).alias("term"), F.lit("b").alias("prior")).distinct().unionByName(p.select(word(1).alias("term"), F.lit("b").alias("prior")).distinct())
    gone = p.select(F.lit("anvil").alias("term")).distinct()
    return governance.candidates(prior, more, gone, F.regexp_replace("term", "s$", ""), [("short", F.length("term") < 4)])


CANONICAL_SQL = """WITH t AS (SELECT DISTINCT split_part(p_name, ' ', 1) || 's' AS term, 'a' AS prior FROM part), m AS (SELECT split_part(p_name, ' ', 1) AS term FROM part WHERE p_size > 10 UNION SELECT split_part(p_name, ' ', 2) FROM part),
u AS (SELECT term, prior FROM t UNION ALL SELECT term, 'b' FROM m WHERE term NOT IN (SELECT term FROM t)), k AS (SELECT * FROM u WHERE term <> 'anvil')
SELECT term, prior, CASE WHEN length(term) < 4 THEN 'short' END AS ambiguous_because FROM k WHERE NOT (term LIKE '%s' AND left(term, length(term) - 1) IN (SELECT term FROM k))"""


def proposals(spark, sf):
    prior = F.when(F.col("p_size") > 40, "old").when(F.col("p_size") > 20, "new")
    kind = governance.proposed(F.col("p_type"), prior, {"PROMO": "moved"}, {"ECONOMY": "added"}, [("old", F.col("p_partkey") % 2 == 0, "even")])
    return table(spark, sf, "part").groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def noise(spark, sf):
    """All groups of markers, and any rule of phrases."""
    n = F.col("note")
    return notes(spark, sf).select("p_partkey", predicates.all_in(n, [("Nose:",), ("Finish:", "Comments:")]).alias("full"), predicates.any_rule(n, [("RED", "ring"), ("anvil", "size 1")]).alias("noise"))


NOISE_SQL = f"SELECT p_partkey, contains(note, 'Finish:') OR contains(note, 'Comments:') AS full, (contains(lower(note), 'red') AND contains(lower(note), 'ring')) OR (contains(lower(note), 'anvil') AND contains(lower(note), 'size 1')) AS noise FROM ({NOTES_SQL})"


def enriched(spark, sf):
    """Entries take the cell of their page and day with the same name, none with a name unlike."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("link"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    name, named = F.translate("k", "0123456789", "abcdefghij"), F.col("o_orderkey") % 3 == 0
    entries = o.select(F.concat(F.lit("e"), "k").alias("entry"), "link", "day", F.when(named, F.concat(F.lit("Lot "), name)).otherwise("Qqqq qqqq").alias("name"))
    cells = o.select("link", "day", F.when(named, F.concat(F.lit("lot   "), name)).otherwise("wwww wwww").alias("cell_name"), F.col("k").alias("cell_text"))
    return linkage.enriched(entries, cells).select("entry", "cell_text")


def ordered_archive(spark, sf):
    """Archive pages by year, month, part and link."""
    o = table(spark, sf, "orders")
    url = F.concat(F.lit("a"), F.date_format("o_orderdate", "MM"), F.date_format("o_orderdate", "yy"), F.lit("-"), (F.col("o_orderkey") % 2 + 1).cast("string"), F.lit(".html"))
    pages = o.select(url.alias("url")).distinct().select("url", predicates.link_year(F.col("url"), r"(\d{2})-\d+\.html").alias("year"), F.substring("url", 2, 2).cast("int").alias("month"), F.regexp_extract("url", r"-(\d+)\.html", 1).cast("int").alias("part"))
    return R.top_k(pages, [F.col("year"), F.col("month"), F.col("part"), F.col("url")], 1_000_000, rank="place").select("place", "url")


ARCHIVE_SQL = """WITH p AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey % 2 + 1 AS part, 'a' || strftime(o_orderdate, '%m%y') || '-' || (o_orderkey % 2 + 1) || '.html' AS url FROM orders)
SELECT row_number() OVER (ORDER BY y, m, part, url)::INT AS place, url FROM p"""


def best_rows(spark, sf):
    """The first rows of two predicates, each row once."""
    p = table(spark, sf, "part")
    cheap = R.top_k(p.filter("p_size > 40"), [F.col("p_retailprice"), F.col("p_partkey")], 20)
    dear = R.top_k(p.filter("p_type = 'PROMO'"), [F.desc("p_retailprice"), F.col("p_partkey")], 20)
    return R.priority_union([cheap, dear], ["p_partkey"]).select("p_partkey", "p_retailprice")


def close_reading(spark, sf):
    """In each language the row of the highest rate, with an excerpt around the first listed word."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text", (F.col("doc_id") * 37 % 101).alias("score"))
    top = R.first_by(d, ["lang"], [F.desc("score"), F.col("doc_id")])
    return top.select("lang", "doc_id", T.excerpt(F.col("text"), ["nothing-like-it"], 5, 7).alias("words"))


def split(spark, sf):
    """Texts of up to four records, cut where one ends and the next begins."""
    one = F.concat("p_name", F.lit(" Colour: x and more of it that is long enough to count as a record, SGP:4 - 80 points. "))
    n = (F.col("p_partkey") % 4 + 1).cast("int")
    texts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.repeat(one, n).alias("text"))
    found = html.split_records(texts, r"SGP:\d+ - \d+ points\.", r"\w+ \w+ Colour:", 6, 40)
    return found.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("points[.]$")).alias("ended"))


def spelled_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(html.link_pattern(F.col("html"), r'href="([^"]+)"'), " ").alias("links"))


def diffs(spark, sf):
    p = table(spark, sf, "part")
    return governance.changed(p, p.withColumn("p_name", F.regexp_replace("p_name", "^red ", "RED ")), "p_partkey", "p_name")


def looked_up(spark, sf):
    """A result of another query by condition, beside the table's own figure."""
    found = governance.value_of(stats.described(table(spark, sf, "part"), ["p_size"]), "max", F.col("variable") == "p_size")
    return table(spark, sf, "part").agg(F.max("p_size").cast("double").alias("own")).withColumn("found", F.lit(float(found)))


def phrases(spark, sf):
    """Pairs joined from the left; a connector between the words of a pair becomes part of it."""
    word = F.split("p_name", " ")
    words = F.when(F.col("p_partkey") % 2 == 0, F.array(word[0], F.lit("of"), word[1], word[0], word[1])).otherwise(F.array(word[0], word[1], word[1]))
    listed = F.array(F.lit("red widget"), F.lit("small ring"), F.lit("ring ring"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(features.joined_pairs(words, listed, ("of", "the")), " ").alias("words"))


PHRASES_SQL = """WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), q AS (SELECT *, a || ' ' || b IN ('red widget', 'small ring', 'ring ring') AS j, a || ' ' || b IN ('red widget', 'small ring') AS k FROM p)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN j THEN a || '_of_' || b || ' ' || a || '_' || b WHEN b || ' ' || a IN ('red widget', 'small ring', 'ring ring') THEN a || ' of ' || b || '_' || a || ' ' || b ELSE a || ' of ' || b || ' ' || a || ' ' || b END
  ELSE CASE WHEN j THEN a || '_' || b || ' ' || b WHEN b = 'ring' THEN a || ' ring_ring' ELSE a || ' ' || b || ' ' || b END END AS words FROM q"""


def scenarios(spark, sf):
    """Counts by order with one more term in a category at a time, as changes of the base counts."""
    l = table(spark, sf, "lineitem")
    base = l.filter("l_linenumber IN (1, 2)").groupBy("l_returnflag", F.when(F.col("l_linenumber") == 1, "air").otherwise("land").alias("category")).agg(F.count("*").alias("n"))
    hits = l.filter("l_linenumber IN (3, 4)").groupBy(F.col("l_linenumber").alias("term"), "l_returnflag").agg(F.count("*").alias("hits"))
    ambiguous = spark.createDataFrame([(3, "land"), (4, "air"), (4, "land")], "term int, category string")
    return models.added_terms(base, ambiguous, hits, ["l_returnflag"])


SCENARIOS_SQL = """WITH a AS (SELECT unnest([3, 4, 4]) AS term, unnest(['land', 'air', 'land']) AS category)
SELECT term || ':' || category AS scenario, l_returnflag, category, count(*) AS n FROM lineitem JOIN a ON l_linenumber = term OR (l_linenumber = 1 AND category = 'air') OR (l_linenumber = 2 AND category = 'land') GROUP BY ALL"""


def primaries(spark, sf):
    p = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") < 3, "primary").otherwise("supplementary").alias("role"), (F.col("r_regionkey") * 2 % 5 / 100.0 + 0.01).alias("p"))
    return vectors.primaries_adjusted(p).select("name", "role", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


PRIMARIES_SQL = """WITH t AS (SELECT r_name AS name, CASE WHEN r_regionkey < 3 THEN 'primary' ELSE 'supplementary' END AS role, r_regionkey * 2 % 5 / 100.0 + 0.01 AS p FROM region),
s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS step FROM t WHERE role = 'primary'), h AS (SELECT name, least(1.0, max(step) OVER (ORDER BY p, name)) AS p_holm FROM s)
SELECT t.name, role, round(p, 6)::DOUBLE AS p, round(p_holm, 6)::DOUBLE AS p_holm FROM t LEFT JOIN h ON h.name = t.name"""


def folds(spark, sf):
    return models.folded(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"]).groupBy("fold").agg(F.count("*").alias("n"))


FOLDS_SQL = "WITH n AS (SELECT count(*) AS n FROM orders) SELECT k::INT AS fold, n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS n FROM n, (SELECT unnest(range(5)) AS k)"


def robust_slope(spark, sf):
    """The slope of a line and its HC1 error, as sums over the rows give them."""
    fit = stats.least_squares(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(r.variable, round(float(r.b), 4), round(float(r.se), 4), round(float(r.statistic), 4), round(float(r.adj_r2), 6)) for r in fit.itertuples() if r.variable != "intercept"], "variable string, b double, se double, statistic double, adj_r2 double")


ROBUST_SQL = """WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS m, count(*) AS n, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem),
e AS (SELECT sum((l_quantity - m) ** 2 * (l_extendedprice - a - b * l_quantity) ** 2) AS meat, sum((l_quantity - m) ** 2) AS sxx FROM lineitem, r)
SELECT 'l_quantity' AS variable, round(b, 4) AS b, round(sqrt(n / (n - 2.0) * meat) / sxx, 4) AS se, round(b / (sqrt(n / (n - 2.0) * meat) / sxx), 4) AS statistic, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2 FROM r, e"""

ALL = {
    "record_heads": (heads, HEADS_SQL),
    "rebuilt_texts": (rebuilt, REBUILT_SQL),
    "name_suffixes": (suffixes, SUFFIXES_SQL),
    "lead_snippets": (snippets, SNIPPETS_SQL),
    "entities": (entities, "SELECT p_partkey, '<b> ' || p_name || ' & café €' || p_size AS plain, 'the ' || p_name || ' 46% % x' AS key FROM part"),
    "similar_names": (similar, SIMILAR_SQL),
    "same_days": (consistent, "SELECT coalesce(l_quantity > 10 AND l_shipdate::DATE = o_orderdate::DATE + 30, false) AS same, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "coefficient_cells": (cells, CELLS_SQL),
    "raw_dots": (dots, DOTS_SQL),
    "category_hits": (counted, "SELECT CASE WHEN p_name = 'small ring' OR p_name = 'red widget' THEN 2 WHEN p_name LIKE '% ring' THEN 1 ELSE 0 END::BIGINT AS hits, count(*) AS n FROM part GROUP BY 1"),
    "largest_column": (largest, LARGEST_SQL),
    "category_ranges": (by_category, "SELECT * FROM (SELECT p_brand, min(p_size) AS low, quantile_cont(p_size, 0.5) AS median, max(p_size) AS high, row_number() OVER (ORDER BY quantile_cont(p_size, 0.5) DESC, p_brand)::INT AS place FROM part GROUP BY 1) WHERE place <= 10"),
    "pivot_firsts": (firsts, FIRSTS_SQL),
    "candidate_terms": (canonical, CANONICAL_SQL),
    "proposed_categories": (proposals, "SELECT CASE WHEN p_type = 'PROMO' THEN 'moved' WHEN p_type = 'ECONOMY' THEN 'added' WHEN p_size > 40 AND p_partkey % 2 = 0 THEN 'even' WHEN p_size > 40 THEN 'old' WHEN p_size > 20 THEN 'new' END AS category, count(*) AS n FROM part GROUP BY 1"),
    "noise_rules": (noise, NOISE_SQL),
    "enriched_entries": (enriched, "SELECT 'e' || o_orderkey AS entry, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR END AS cell_text FROM orders"),
    "archive_order": (ordered_archive, ARCHIVE_SQL),
    "best_rows": (best_rows, "SELECT p_partkey, p_retailprice FROM (SELECT * FROM part WHERE p_size > 40 ORDER BY p_retailprice, p_partkey LIMIT 20) UNION SELECT p_partkey, p_retailprice FROM (SELECT * FROM part WHERE p_type = 'PROMO' ORDER BY p_retailprice DESC, p_partkey LIMIT 20)"),
    "close_reading": (close_reading, r"WITH t AS (SELECT lang, doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w, row_number() OVER (PARTITION BY lang ORDER BY doc_id * 37 % 101 DESC, doc_id) AS k FROM documents) SELECT lang, doc_id, array_to_string(w[1:7], ' ') AS words FROM t WHERE k = 1"),
    "split_records": (split, "SELECT p_partkey::VARCHAR AS key, p_partkey % 4 + 1 AS n, p_partkey % 4 + 1 AS ended FROM part"),
    "spelled_links": (spelled_links, """SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))), ' ') AS links FROM pages"""),
    "changed_rows": (diffs, "SELECT p_partkey, p_name AS before, 'RED ' || substr(p_name, 5) AS after FROM part WHERE p_name LIKE 'red %' ORDER BY p_partkey LIMIT 5"),
    "result_lookup": (looked_up, "SELECT max(p_size)::DOUBLE AS own, max(p_size)::DOUBLE AS found FROM part"),
    "joined_phrases": (phrases, PHRASES_SQL),
    "added_terms": (scenarios, SCENARIOS_SQL),
    "primary_tests": (primaries, PRIMARIES_SQL),
    "folds": (folds, FOLDS_SQL),
    "robust_slope": (robust_slope, ROBUST_SQL),
}
