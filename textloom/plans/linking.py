"""Queries of record linkage, web pages and incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import values as V
from textloom.operators import html, linkage
from textloom.operators.governance import errors
from textloom.sources.tables import shared_folder, table
from textloom.streaming import ingest


def corpus(spark, sf):
    """Records made of orders and their parts: a link by month, a name, a score and a day."""
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    rows = o.join(p, F.pmod(F.col("o_orderkey") * 7, F.lit(199)) == F.col("p_partkey"))
    return rows.select(F.concat(F.lit("r"), "o_orderkey").alias("record"), F.concat(F.lit("https://Example.org/a/"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".html")).alias("link"), F.concat_ws(" ", "p_name", "p_brand", (F.col("o_orderkey") % 400).cast("string")).alias("name"), (F.col("o_orderkey") % 40 + 60).cast("int").alias("score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat_ws(" ", F.lit("Text of"), "p_name", "o_orderkey").alias("text"))


def index(spark, sf):
    """An entry for every record: some with another link, spelling or day."""
    c = corpus(spark, sf).withColumn("k", F.substring("record", 2, 20).cast("long"))
    other = F.col("k") % 9 == 0
    return c.select(
        F.concat(F.lit("e"), "k").alias("entry"),
        F.when(other, "https://example.org/b.html").otherwise(F.lower("link")).alias("link"),
        F.when(F.col("k") % 27 == 0, F.concat(F.lit("The "), "name")).otherwise(F.upper("name")).alias("name"),
        "score",
        "day",
        F.when(F.col("k") % 2 == 0, F.col("text")).otherwise("").alias("snippet"),
        F.when(F.col("k") % 5 == 0, "auxiliary").otherwise("named").alias("page_kind"),
    )


def linked(spark, sf):
    return linkage.linked(index(spark, sf), corpus(spark, sf))


#: The cascade up to the records of an entry's own name and score: their ratio is 1, and several make each other doubtful.
LINKED_CTE = """
c AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m') AS link, lower(p_name || ' ' || p_brand || ' ' || (o_orderkey % 400)) AS name, o_orderkey % 40 + 60 AS score, o_orderdate::DATE AS day,
             lower('Text of ' || p_name || ' ' || o_orderkey) AS body FROM orders JOIN part ON (o_orderkey * 7) % 199 = p_partkey),
i AS (SELECT k AS e, CASE WHEN k % 9 = 0 THEN 'b' ELSE link END AS link, CASE WHEN k % 27 = 0 THEN 'the ' || name ELSE name END AS name, score, day, CASE WHEN k % 2 = 0 THEN left(body, 80) ELSE '' END AS lead, k % 5 <> 0 AS named FROM c),
l AS (SELECT e, c.k, i.name = c.name AS same, count(*) OVER (PARTITION BY e) AS n FROM i JOIN c ON i.link = c.link AND i.day = c.day),
t1 AS (SELECT e, k FROM (SELECT e, k, n, same, count(*) FILTER (WHERE same) OVER (PARTITION BY e) AS m FROM l) WHERE n = 1 OR (same AND m = 1)),
n AS (SELECT e, c.k, lead, body, i.day = c.day AS one_day, count(*) OVER (PARTITION BY e) AS n FROM i JOIN c ON i.name = c.name AND i.score = c.score WHERE e NOT IN (SELECT e FROM t1)),
t2 AS (SELECT e, k FROM n WHERE n = 1),
s AS (SELECT e, k, count(*) OVER (PARTITION BY e) AS m FROM n WHERE n > 1 AND lead <> '' AND contains(body, lead)),
t3 AS (SELECT e, k FROM s WHERE m = 1),
f AS (SELECT e, k, row_number() OVER (PARTITION BY e ORDER BY 'r' || k) AS place FROM n WHERE n > 1 AND e NOT IN (SELECT e FROM t3)),
a AS (SELECT e, k, 'exact_link' AS method FROM t1 UNION ALL SELECT e, k, 'exact_name_score' FROM t2 UNION ALL SELECT e, k, 'exact_name_score_snippet' FROM t3 UNION ALL SELECT e, k, 'fuzzy_low' FROM f WHERE place = 1),
m AS (SELECT i.e, a.k, coalesce(method, 'unmatched') AS method FROM i LEFT JOIN a ON a.e = i.e)
"""


def block_sql(x: str, y: str) -> str:
    """The longest common block of two texts, of several the first in ``x``: its length n and its place -i in ``x``."""
    longest = f"len(list_filter(range(1, length({x}) - i + 2), lambda n: contains({y}, substr({x}, i, n))))"
    return f"list_max(list_transform(range(1, length({x}) + 1), lambda i: {{'n': {longest}, 'i': -i}}))"


#: The rest of the cascade: names without an equal of their score against all names of that score, by the sum of the blocks that
#: they share (on both sides of the longest one in turn). A ratio of 1 - d / S takes an edit distance of at most d.
FUZZY_CTE = f"""{LINKED_CTE.replace("m AS (SELECT i.e, a.k, coalesce(method, 'unmatched') AS method FROM i LEFT JOIN a ON a.e = i.e)", "").rstrip()}
u AS (SELECT e, name, score, day FROM i WHERE e NOT IN (SELECT e FROM t1) AND e NOT IN (SELECT e FROM n)),
h AS (SELECT name, score, count(*) AS records, min('r' || k) AS record, arg_min(k, 'r' || k) AS k, arg_min(day, 'r' || k) AS day FROM c GROUP BY name, score),
p AS (SELECT DISTINCT u.name AS a, h.name AS b FROM u JOIN h ON h.score = u.score WHERE levenshtein(u.name, h.name) <= 0.2201 * (length(u.name) + length(h.name))),
g AS (SELECT a, b, a AS x, b AS y, {block_sql("a", "b")} AS most FROM p
      UNION ALL SELECT a, b, x, y, {block_sql("x", "y")} FROM (SELECT a, b, side.x AS x, side.y AS y FROM (
        SELECT a, b, unnest([{{'x': left(x, place - 1), 'y': left(y, spot - 1)}}, {{'x': substr(x, place + n), 'y': substr(y, spot + n)}}]) AS side
        FROM (SELECT a, b, x, y, -most.i AS place, most.n AS n, strpos(y, substr(x, -most.i, most.n)) AS spot FROM g WHERE most.n > 0))) WHERE x <> '' AND y <> ''),
q AS (SELECT a, b, 2e0 * sum(most.n) / (length(a) + length(b)) AS ratio FROM g GROUP BY a, b),
v AS (SELECT u.e, h.k, q.ratio, u.day = h.day AS one_day, sum(records) FILTER (q.ratio >= 0.88) OVER (PARTITION BY u.e) AS rivals, row_number() OVER (PARTITION BY u.e ORDER BY q.ratio DESC, h.record) AS place
      FROM u JOIN q ON q.a = u.name JOIN h ON h.name = q.b AND h.score = u.score WHERE q.ratio >= 0.78),
m AS (SELECT i.e, coalesce(a.k, v.k) AS k, coalesce(a.method, CASE WHEN v.ratio >= 0.88 AND v.rivals = 1 AND v.one_day THEN 'fuzzy_high' WHEN v.k IS NOT NULL THEN 'fuzzy_low' END, 'unmatched') AS method,
      CASE WHEN a.k IS NOT NULL THEN 1.0 WHEN v.k IS NOT NULL THEN round(v.ratio, 4) ELSE 0.0 END::DOUBLE AS confidence FROM i LEFT JOIN a ON a.e = i.e LEFT JOIN v ON v.e = i.e AND v.place = 1)
"""
LINKED_SQL = f"WITH RECURSIVE {FUZZY_CTE} SELECT 'e' || e AS entry, 'r' || k AS record, method, confidence FROM m"


def spelled_records(spark, sf):
    """A record for each order, its name 32 letters that no other name resembles."""
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("r"), "o_orderkey").alias("record"), F.lit(None).cast("string").alias("link"), F.translate(F.md5(F.col("o_orderkey").cast("string")), "0123456789", "ghijklmnop").alias("name"), (F.col("o_orderkey") % 1009).cast("int").alias("score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("").alias("text"))


def spelled_entries(spark, sf):
    """An entry for each of them; of nine, one has more letters, one fewer and one far fewer, some another day."""
    r = spelled_records(spark, sf).withColumn("k", F.substring("record", 2, 20).cast("long"))
    name = F.when(F.col("k") % 9 == 0, F.concat(F.lit("the "), "name")).when(F.col("k") % 9 == 1, F.left("name", F.lit(22))).when(F.col("k") % 9 == 2, F.left("name", F.lit(18))).otherwise(F.col("name"))
    day = F.when(F.col("k") % 27 == 0, "1970-01-01").otherwise(F.col("day"))
    return r.select(F.concat(F.lit("e"), "k").alias("entry"), "link", name.alias("name"), "score", day.alias("day"), F.lit("").alias("snippet"), F.lit("named").alias("page_kind"))


def similar_links(spark, sf):
    return linkage.linked(spelled_entries(spark, sf), spelled_records(spark, sf))


#: With M common characters of S the ratio is 2 M / S: 64 / 68 and 44 / 54 are found, 36 / 50 is below the least ratio.
SIMILAR_SQL = """SELECT 'e' || o_orderkey AS entry, CASE WHEN o_orderkey % 9 <> 2 THEN 'r' || o_orderkey END AS record,
CASE o_orderkey % 9 WHEN 0 THEN CASE WHEN o_orderkey % 27 = 0 THEN 'fuzzy_low' ELSE 'fuzzy_high' END WHEN 1 THEN 'fuzzy_low' WHEN 2 THEN 'unmatched' ELSE 'exact_name_score' END AS method,
CASE o_orderkey % 9 WHEN 0 THEN 0.9412 WHEN 1 THEN 0.8148 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM orders"""


def exact_links(spark, sf):
    # fuzzy matches come after all exact ones, which are the same without them
    return linkage.linked(index(spark, sf), corpus(spark, sf), pool=0).filter("method IN ('exact_link', 'exact_name_score')").select("entry", "record", "method")


EXACT_SQL = f"WITH {LINKED_CTE} SELECT 'e' || e AS entry, 'r' || k AS record, method FROM m WHERE method IN ('exact_link', 'exact_name_score')"


def strict_records(spark, sf):
    return linkage.winners(linked(spark, sf), index(spark, sf), corpus(spark, sf)).groupBy("method", "strict", "expanded").agg(F.count("*").alias("n"))


STRICT_SQL = f"""WITH RECURSIVE {FUZZY_CTE}, w AS (SELECT m.k, m.method, i.named, i.day, row_number() OVER (PARTITION BY m.k ORDER BY i.named DESC, m.confidence DESC, 'e' || m.e) AS place FROM m JOIN i ON i.e = m.e WHERE m.k IS NOT NULL)
SELECT w.method, coalesce(w.named AND w.method LIKE 'exact%' AND w.day = c.day, false) AS strict, coalesce(w.named AND (w.method LIKE 'exact%' OR w.method = 'fuzzy_high') AND w.day = c.day, false) AS expanded, count(*) AS n
FROM c LEFT JOIN w ON w.k = c.k AND w.place = 1 GROUP BY ALL"""


def audit(spark, sf):
    return linkage.audited(linked(spark, sf), index(spark, sf), corpus(spark, sf)).groupBy("reasons").agg(F.count("*").alias("n"))


AUDIT_SQL = f"""WITH RECURSIVE {FUZZY_CTE}, r AS (SELECT m.method, m.confidence < 0.88 AS low, i.day <> c.day AS moved, i.score <> c.score AS other, m.k, count(m.k) OVER (PARTITION BY m.k) AS n FROM m JOIN i ON i.e = m.e LEFT JOIN c ON c.k = m.k)
SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN k IS NULL THEN 'unmatched' END, CASE WHEN method LIKE 'fuzzy%' THEN 'fuzzy' END, CASE WHEN k IS NOT NULL AND low THEN 'low_confidence' END, CASE WHEN moved THEN 'date_differs' END, CASE WHEN other THEN 'score_differs' END, CASE WHEN k IS NOT NULL AND n > 1 THEN 'several_entries' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM r) WHERE reasons <> '' GROUP BY reasons"""


def memberships(spark, sf):
    keyed = corpus(spark, sf).withColumn("content_key", F.sha2("record", 256))
    return linkage.memberships(linked(spark, sf), index(spark, sf), keyed, "content_key", ["page_kind"])


MEMBERSHIPS_SQL = f"WITH RECURSIVE {FUZZY_CTE} SELECT sha256('r' || m.k) AS content_key, 'e' || m.e AS entry, CASE WHEN i.named THEN 'named' ELSE 'auxiliary' END AS page_kind, m.method FROM m JOIN i ON i.e = m.e WHERE m.k IS NOT NULL"


#: Orders that a task makes pages of, where there are as many; a page is never cut.
PAGED = 100_000


def day_pages(spark, sf):
    """A page for each order day; every seventh order's label has no strength, so its title is doubtful.

    Orders are dealt by page before their cells are made, to so many tasks that those a task holds don't grow with the table."""
    k = F.col("o_orderkey").cast("string")
    head = F.concat(F.lit('<font color="x">'), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</font>"))
    label = F.concat(F.lit("Lot "), k, F.when(F.col("o_orderkey") % 7 == 0, " (cask)").otherwise(" (46%, cask)"))
    cell = F.concat(F.lit("<table><tr><td><span class='name'>"), label, F.lit("</span> Colour: gold. Nose: fresh and long &amp; fine, with more of it. Mouth: good. Finish: long. "), (F.col("o_orderkey") % 41 + 60).cast("string"), F.lit(" points</td></tr></table>"))
    day = F.date_format("o_orderdate", "yyyyMMdd")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("p"), day).alias("url"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), orders.count() // PAGED)
    return orders.repartition(tasks, "url").select("url", head.alias("head"), cell.alias("cell")).groupBy("url", "head").agg(F.array_join(F.array_sort(F.collect_list("cell")), "").alias("cells")).select("url", F.concat("head", "cells").alias("html"))


def page_records(spark, sf):
    found = html.page_records(day_pages(spark, sf), (r"<font[^>]*>\s*([A-Z][a-z]+\s+\d{1,2},\s*\d{4})\s*</font>",), ("Colour:", "Nose:", "Mouth|Palate:"), "name")
    return found.select("day", "title", "score", "doubtful")


PAGE_SQL = "SELECT o_orderdate::DATE::VARCHAR AS day, 'Lot ' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN ' (cask)' ELSE ' (46%, cask)' END AS title, (o_orderkey % 41 + 60)::INT AS score, o_orderkey % 7 = 0 AS doubtful FROM orders"


def index_pages(spark, sf):
    """An index page for each customer: an entry for each order, one of them twice, and a sidebar that repeats them all."""
    k = F.col("o_orderkey").cast("string")
    link = F.concat(F.lit("../archive"), F.date_format("o_orderdate", "yyMM"), F.lit("-1.html#"), F.date_format("o_orderdate", "ddMMyy"))
    anchor = F.concat(F.lit('<a href="'), link, F.lit('">Lot '), k, F.lit("</a>"))
    item = F.concat(F.lit("<li>A note on <b>lot "), k, F.lit("</b>, "), anchor, F.lit("</li>"))
    both = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"), F.array_join(F.collect_list(anchor), " ").alias("anchors"))
    page = F.concat(F.lit("<table><tr><td>Latest entries "), "anchors", F.lit("</td></tr></table><ul>"), "items", F.lit("</ul><p>Elsewhere: <a href='x.html'>x</a></p>"))
    return both.select(F.concat(F.lit("http://a.org/index/c"), "o_custkey", F.lit(".html")).alias("url"), page.alias("html"))


def index_entries(spark, sf):
    found = html.index_entries(index_pages(spark, sf), "a.org", "latest entries")
    return found.select("src", "dst", "fragment", V.short_date(F.col("fragment")).cast("string").alias("day"), "label", "text")


ENTRIES_SQL = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY '<li>A note on <b>lot ' || o_orderkey || '</b>') AS place FROM orders)
SELECT 'http://a.org/index/c' || o_custkey || '.html' AS src, 'http://a.org/archive' || strftime(d, '%y%m') || '-1.html' AS dst, strftime(d, '%d%m%y') AS fragment, d::VARCHAR AS day, 'Lot ' || o_orderkey AS label, 'A note on lot ' || o_orderkey || ' ,' AS text FROM o WHERE place = 1"""


def next_rows(spark, sf):
    """Tables in which a header row stands before each row."""
    r = table(spark, sf, "supplier")
    rows = F.concat(F.lit("<tr><td>Head "), F.col("s_suppkey").cast("string"), F.lit("</td></tr><tr><td>"), "s_name", F.lit("</td></tr>"))
    pages = r.groupBy("s_nationkey").agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(rows)), ""), F.lit("</table>")).alias("html")).select(F.col("s_nationkey").cast("string").alias("url"), "html")
    return html.next_rows(pages, "^Head").select("header", "next")


def archive_links(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 6)
    key = F.col("o_orderkey").cast("string")
    forms = [F.concat(F.lit("archive-"), key, F.lit(".html#010203")), F.concat(F.lit("/x/Archive-"), key, F.lit(".html")), F.concat(F.lit("https://a.org/archive/"), key, F.lit(".html")), F.concat(F.lit("//b.org/archive"), key, F.lit(".html")), F.concat(F.lit("archive-"), key, F.lit(".pdf")), F.concat(F.lit("page"), key, F.lit(".html"))]
    href = F.coalesce(*[F.when(F.col("k") == n, f) for n, f in enumerate(forms)])
    return o.select("o_orderkey", html.archive_link(F.lit("https://a.org/dir/index.html"), href, "a.org").alias("link"))


ARCHIVE_SQL = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'https://a.org/dir/archive-' || o_orderkey || '.html' WHEN 1 THEN 'https://a.org/x/Archive-' || o_orderkey || '.html' WHEN 2 THEN 'https://a.org/archive/' || o_orderkey || '.html' END AS link FROM orders"


def page_links(spark, sf):
    return html.links(table(spark, sf, "pages")).groupBy("src").agg(F.count("*").alias("n"))


def navigation(spark, sf):
    return html.split_links(table(spark, sf, "pages"), "<article").groupBy("kind").agg(F.count("*").alias("n"))


NAVIGATION_SQL = r"""WITH a AS (SELECT url, html, strpos(html, '<article') AS spot FROM pages),
s AS (SELECT url, CASE WHEN spot = 0 THEN html ELSE left(html, spot - 1) END AS before, CASE WHEN spot = 0 THEN '' ELSE substr(html, spot) END AS after FROM a),
h AS (SELECT url, unnest(list_distinct(regexp_extract_all(before, '(?is)<a\b[^>]*?href\s*=\s*["'']?([^"''\s>]+)[^>]*>.*?</a>', 1))) AS href, 'named' AS kind FROM s
      UNION ALL SELECT url, unnest(list_distinct(regexp_extract_all(after, '(?is)<a\b[^>]*?href\s*=\s*["'']?([^"''\s>]+)[^>]*>.*?</a>', 1))), 'auxiliary' FROM s),
f AS (SELECT url, href, max(kind) AS kind FROM h GROUP BY url, href) SELECT kind, count(*) AS n FROM f GROUP BY kind"""


def ingested(spark, sf):
    """The events as a file stream, each property text once, appended by month; what the sink then holds."""
    base = f"{shared_folder(spark)}/textloom/ingest-{uuid.uuid4().hex}"
    table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    stream = ingest.once(ingest.files(spark, f"{base}/in", schema), "props")
    ingest.append_months(stream, "ts", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("record").agg(F.count("*").alias("n"))


def ingested_ledger(spark, sf):
    """The events as a file stream in several batches, each property text once, without state beside the table."""
    base = f"{shared_folder(spark)}/textloom/ledger-{uuid.uuid4().hex}"
    table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(f"{base}/in")
    stream = ingest.files(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, most=1)
    ingest.add_once(stream, "props", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("record").agg(F.count("*").alias("n"))


def worksheet_errors(spark, sf):
    p = table(spark, sf, "part")
    sheet = p.select(F.col("p_name").alias("term"), F.col("p_type").alias("proposed_category"), F.col("p_size").alias("review_frequency"), F.when(F.col("p_partkey") % 2 == 0, "approved").otherwise("rejected").alias("status"), F.lit("").alias("decision"), F.lit("seen").alias("rationale"))
    return errors(sheet, ["ECONOMY", "NONE"], 5).groupBy("error").agg(F.count("*").alias("n"))


ERRORS_SQL = """
WITH s AS (SELECT p_name AS t, p_type AS c, p_size AS f, p_partkey % 2 = 0 AS a FROM part), e AS (
  SELECT 'unknown category: ' || t AS error FROM s WHERE a AND c NOT IN ('ECONOMY', 'NONE')
  UNION ALL SELECT 'too rare: ' || t FROM s WHERE a AND f < 5
  UNION ALL SELECT 'approved twice: ' || t FROM s WHERE a GROUP BY t HAVING count(*) > 1
  UNION ALL SELECT 'empty category: ' || c FROM (SELECT unnest(['ECONOMY', 'NONE']) AS c) k WHERE c NOT IN (SELECT c FROM s WHERE a))
SELECT error, count(*) AS n FROM e GROUP BY error
"""

ALL = {
    "linked": (linked, LINKED_SQL),
    "similar_links": (similar_links, SIMILAR_SQL),
    "exact_links": (exact_links, EXACT_SQL),
    "strict_records": (strict_records, STRICT_SQL),
    "link_audit": (audit, AUDIT_SQL),
    "memberships": (memberships, MEMBERSHIPS_SQL),
    "page_records": (page_records, PAGE_SQL),
    "page_links": (page_links, None),
    "navigation": (navigation, NAVIGATION_SQL),
    "index_entries": (index_entries, ENTRIES_SQL),
    "next_rows": (next_rows, "SELECT 'Head ' || s_suppkey AS header, s_name AS next FROM supplier"),
    "archive_links": (archive_links, ARCHIVE_SQL),
    "ingested": (ingested, "SELECT sha256(trim(regexp_replace(props, '\\s+', ' ', 'g'))) AS record, 1::BIGINT AS n FROM events GROUP BY 1"),
    "ingested_ledger": (ingested_ledger, "SELECT sha256(trim(regexp_replace(props, '\\s+', ' ', 'g'))) AS record, 1::BIGINT AS n FROM events GROUP BY 1"),
    "worksheet_errors": (worksheet_errors, ERRORS_SQL),
}
