"""Queries that parse pages in SQL, by table functions joined laterally."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import values as V
from textloom.operators import html, lateral
from textloom.plans.linking import ENTRIES_SQL, PAGE_SQL, day_pages, index_pages
from textloom.sources.tables import table

MARKERS = ("Colour:", "Nose:", "Mouth|Palate:")


def page_records(spark, sf):
    found = lateral.parsed_by(
        spark,
        r"""SELECT p.url, d.day, c.text FROM {pages} p,
        LATERAL day_fragments(p.html, array(r'<font[^>]*>\s*([A-Z][a-z]+\s+\d{{1,2}},\s*\d{{4}})\s*</font>')) d,
        LATERAL record_cells(d.fragment, array('Colour:', 'Nose:', 'Mouth|Palate:'), 'name', 80) c""",
        pages=day_pages(spark, sf),
    )
    return html.titled_records(found, MARKERS).select("day", "title", "score", "doubtful")


def index_entries(spark, sf):
    found = lateral.parsed_by(spark, "SELECT p.url AS src, e.* FROM {pages} p, LATERAL index_links(p.url, p.html, 'a.org', 'latest entries') e", pages=index_pages(spark, sf))
    return html.tidy_entries(found).select("src", "dst", "fragment", V.short_date(F.col("fragment")).cast("string").alias("day"), "label", "text")


def linked_pages(spark, sf):
    """Links of all pages by the page they lead to."""
    return lateral.parsed_by(spark, "SELECT l.dst, count(*) AS n FROM {pages} p, LATERAL page_links(p.url, p.html) l GROUP BY l.dst", pages=index_pages(spark, sf))


#: The sidebar repeats the entries, and every page has one more link.
LINKED_PAGES_SQL = """
SELECT dst, count(*) AS n FROM (SELECT DISTINCT o_custkey, 'http://a.org/archive' || strftime(o_orderdate::DATE, '%y%m') || '-1.html' AS dst FROM orders
  UNION ALL SELECT DISTINCT o_custkey, 'http://a.org/index/x.html' FROM orders) GROUP BY dst
"""


def cleaned(spark, sf):
    """Texts of one to four records, some with no title of their own, as clean records."""
    k = F.col("p_partkey")
    title = F.concat(F.lit("Lot "), k.cast("string"), F.lit(" (46%, cask)"))
    body = F.concat(F.lit("Colour:  gold, and long enough to be a record. SGP:441 - "), (k % 40 + 60).cast("string"), F.lit(" points. "))
    text = F.when(k % 5 == 0, body).otherwise(F.repeat(F.concat(title, F.lit("  an intro. "), body), (k % 4 + 1).cast("int")))
    rows = table(spark, sf, "part").select("p_partkey", F.concat(title, F.lit(" ")).alias("name"), text.alias("text"))
    found = lateral.cleaned_records(rows, r"SGP:\d+ - \d+ points\.", r"Lot \d+ \(", ("Colour:", "Color:"), r"(\d{1,3}) points", least=40)
    return found.select("p_partkey", "part", "name", "score", "content_key")


CLEANED_SQL = """
WITH p AS (SELECT p_partkey, 'Lot ' || p_partkey || ' (46%, cask)' AS name, p_partkey % 40 + 60 AS score, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE p_partkey % 4 + 1 END AS n FROM part)
SELECT p_partkey, part::INT AS part, name, score::INT AS score, sha256(name || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' an intro.' END || ' Colour: gold, and long enough to be a record. SGP:441 - ' || score || ' points.') AS content_key
FROM (SELECT *, unnest(range(n)) AS part FROM p)
"""

ALL = {
    "page_records_lateral": (page_records, PAGE_SQL),
    "index_entries_lateral": (index_entries, ENTRIES_SQL),
    "linked_pages": (linked_pages, LINKED_PAGES_SQL),
    "cleaned_records": (cleaned, CLEANED_SQL),
}
