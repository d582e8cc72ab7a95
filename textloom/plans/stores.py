"""Queries of sources and sinks: what is written to the shared folder and read back, with SQL over the tables it came from."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

from textloom.operators import governance
from textloom.sources import tables
from textloom.sources.tables import shared_folder, table


def place(spark, name):
    return f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def parts(spark, sf):
    """Parts with texts that CSV must quote: marks, line breaks, blanks."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('a "b", '), "p_name", F.lit("\nend"))).when(F.col("p_partkey") % 3 == 1, F.lit("NA")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), "p_retailprice", F.when(F.col("p_size") > 25, F.col("p_size")).cast("int").alias("size"))


PARTS_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a "b", ' || p_name || chr(10) || 'end' WHEN p_partkey % 3 = 1 THEN 'NA' ELSE p_name END AS name, p_retailprice, CASE WHEN p_size > 25 THEN p_size END::INT AS size FROM part"""
SCHEMA = tables.struct(p_partkey=LongType(), name=StringType(), p_retailprice=DoubleType(), size=IntegerType())


def csv_schema(spark, sf):
    at = place(spark, "csv")
    tables.write_csv(parts(spark, sf), at, SCHEMA.names)
    return tables.csv(spark, at, SCHEMA)


def csv_glob(spark, sf):
    """Two folders by one glob; each row says how many files it was read from."""
    at = place(spark, "glob")
    p = parts(spark, sf)
    tables.write_csv(p.filter("p_partkey % 2 = 0").repartition(2), f"{at}/even", SCHEMA.names)
    tables.write_csv(p.filter("p_partkey % 2 = 1").coalesce(1), f"{at}/odd", SCHEMA.names)
    read = tables.csv_in_order(spark, f"{at}/*", SCHEMA)
    return read.groupBy("size").agg(F.count("*").alias("n"), F.countDistinct("place").alias("n_places"))


def csv_inferred(spark, sf):
    at = place(spark, "inferred")
    tables.write_csv(parts(spark, sf), at, SCHEMA.names)
    read = tables.csv(spark, at)
    kinds = dict(read.dtypes)
    return read.select("p_partkey", "p_retailprice", "size", F.lit(kinds["p_retailprice"]).alias("kind"))


def csv_texts(spark, sf):
    """Without detection of missing values all cells are texts, and blanks are empty ones."""
    at = place(spark, "texts")
    tables.write_csv(parts(spark, sf), at, SCHEMA.names)
    return tables.csv(spark, at, blank_is_value=True).select("p_partkey", "name", "size")


def listed_links(spark, sf):
    """Lines that are JSON objects or links by themselves, and blank ones."""
    at = place(spark, "lines")
    url = F.col("url")
    line = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct("url", "page_id"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("  "), url)).otherwise("")
    table(spark, sf, "pages").select(line.alias("value")).write.text(at)
    return tables.json_lines(spark, at)


def dictionary(spark, sf):
    at = place(spark, "dictionary")
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").orderBy("r_name", "n_name").collect()  # a dictionary's terms
    document = {"status": "frozen", "categories": {r: {"short_name": r[:2].lower(), "terms": [x["n_name"] for x in rows if x["r_name"] == r]} for r in {x["r_name"] for x in rows}}}
    spark.createDataFrame([(json.dumps(document, indent=1),)], "value string").coalesce(1).write.text(at)
    return tables.dictionary(spark, at)


def dictionary_documents(spark, sf):
    """A document a line for each size: some are not frozen, some are cut off."""
    at = place(spark, "dictionaries")
    p = table(spark, sf, "part").filter("p_type IS NOT NULL")
    entries = p.groupBy("p_size", "p_type").agg(F.array_sort(F.collect_set("p_name")).alias("terms")).withColumn("entry", F.struct(F.lower(F.left("p_type", F.lit(2))).alias("short_name"), "terms"))
    packed = entries.groupBy("p_size").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "entry"))).alias("categories"))
    status = F.when(F.col("p_size") % 10 == 0, "draft").otherwise("frozen")
    text = F.to_json(F.struct(F.col("p_size").alias("size"), status.alias("status"), "categories"))
    packed.select(F.when(F.col("p_size") % 10 == 7, F.left(text, F.lit(60))).otherwise(text)).write.text(at)
    found = tables.dictionaries(spark, at, whole=False)
    return found.groupBy("category", "short_name", "term", "error").agg(F.countDistinct("document").alias("n"))


DOCUMENTS_SQL = """
SELECT p_type AS category, lower(left(p_type, 2)) AS short_name, p_name AS term, NULL::VARCHAR AS error, count(DISTINCT p_size) AS n FROM part WHERE p_size % 10 NOT IN (0, 7) AND p_type IS NOT NULL AND p_name IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, CASE p_size % 10 WHEN 0 THEN 'not frozen' ELSE 'no dictionary' END AS error, count(DISTINCT p_size) FROM part WHERE p_size % 10 IN (0, 7) AND p_type IS NOT NULL GROUP BY ALL
"""


def longest_names(spark, sf):
    names = tables.names_by_length(table(spark, sf, "part"), "p_type", F.col("p_size") > 10)
    return names.groupBy(F.length("p_type").alias("size")).agg(F.array_join(F.array_sort(F.collect_list("p_type")), ",").alias("names"))


def manifest(spark, sf):
    o = table(spark, sf, "orders")
    return tables.manifest(o.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.countDistinct("o_custkey").alias("keys")))


def counted_files(spark, sf):
    """Records, not lines, of each file: fields hold line breaks."""
    at = place(spark, "counts")
    tables.write_csv(parts(spark, sf).repartition(3, "p_partkey"), at, SCHEMA.names)
    return tables.file_counts(tables.csv(spark, at, SCHEMA)).agg(F.sum("n").alias("n"), F.count("*").alias("files"))


def event_log(spark, sf):
    """Two runs add to one log."""
    at = place(spark, "log")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("event"))
    tables.write_lines(o, at)
    tables.write_lines(o.filter("event = 'F'"), at)
    return spark.read.json(at).groupBy("event").agg(F.count("*").alias("n"))


def rewritten(spark, sf):
    """A table is replaced by one that is made from it; then one partition of another."""
    at, by = place(spark, "whole"), place(spark, "parted")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    o.write.parquet(at)
    tables.replace_table(spark.read.parquet(at).filter("o_custkey % 2 = 0"), at)
    spark.read.parquet(at).write.partitionBy("o_orderstatus").parquet(by)
    tables.replace_partitions(o.filter("o_orderstatus = 'F'").withColumn("o_custkey", F.lit(0).cast("long")), by, ["o_orderstatus"])
    return spark.read.parquet(by).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_custkey").cast("long")).alias("keys"))


def monthly(spark, sf):
    at = place(spark, "months")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    tables.append_by_month(o.filter("o_orderkey % 2 = 0"), at, "day")
    tables.append_by_month(o.filter("o_orderkey % 2 = 1"), at, "day")
    return spark.read.parquet(at).groupBy(F.col("ym").cast("string").alias("ym")).agg(F.count("*").alias("n"))


def known_content(spark, sf):
    """Links with cached content, and the number of those without."""
    p = table(spark, sf, "pages")
    cache = p.filter("page_id % 2 = 0").select(F.sha2("url", 256).alias("key"), F.length("html").alias("content")).dropDuplicates(["key"])
    there, gone = tables.cached(p.select("url").distinct(), cache)
    return there.agg(F.lit("there").alias("side"), F.count("*").alias("n")).unionByName(gone.agg(F.lit("gone").alias("side"), F.count("*").alias("n")))


def unseen(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("record"), "doc_id")
    return tables.unseen(d, d.filter("doc_id < 100"), ["record"]).select("record")


def frozen(spark, sf):
    p = table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.count("*").cast("string").alias("review_frequency"))
    sheet = p.select(F.concat_ws(" ", "p_name", "p_type").alias("term"), F.col("p_type").alias("proposed_category"), "review_frequency", F.lit("approved").alias("status"), F.lit("").alias("decision"), F.lit("counted").alias("rationale"))
    kinds = [r["proposed_category"] for r in sheet.select("proposed_category").distinct().orderBy("proposed_category").collect()]  # categories
    return governance.frozen(sheet, kinds, 1)


ALL = {
    "csv_schema": (csv_schema, PARTS_SQL),
    "csv_glob": (csv_glob, f"SELECT size, count(*) AS n, count(*) AS n_places FROM ({PARTS_SQL}) GROUP BY size"),
    "csv_inferred": (csv_inferred, f"SELECT p_partkey, p_retailprice, size, 'double' AS kind FROM ({PARTS_SQL})"),
    "csv_texts": (csv_texts, f"SELECT p_partkey::VARCHAR AS p_partkey, name, coalesce(size::VARCHAR, '') AS size FROM ({PARTS_SQL})"),
    "listed_links": (listed_links, "SELECT url FROM pages WHERE page_id % 3 < 2"),
    "dictionary": (dictionary, "SELECT r_name AS category, lower(left(r_name, 2)) AS short_name, n_name AS term FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "dictionary_documents": (dictionary_documents, DOCUMENTS_SQL),
    "names_by_length": (longest_names, "SELECT length(p_type)::INT AS size, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS names FROM part WHERE p_size > 10 GROUP BY 1"),
    "manifest": (manifest, """SELECT '{"n":' || count(*) || ',"low":' || min(o_orderkey) || ',"high":' || max(o_orderkey) || ',"keys":' || count(DISTINCT o_custkey) || '}' AS manifest FROM orders"""),
    "counted_files": (counted_files, "SELECT count(*) AS n, 3::BIGINT AS files FROM part"),
    "event_log": (event_log, "SELECT o_orderstatus AS event, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END * count(*) AS n FROM orders GROUP BY o_orderstatus"),
    "rewritten": (rewritten, "SELECT o_orderstatus, count(*) AS n, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE sum(o_custkey) END::BIGINT AS keys FROM orders WHERE o_orderstatus = 'F' OR o_custkey % 2 = 0 GROUP BY o_orderstatus"),
    "monthly": (monthly, "SELECT strftime(o_orderdate, '%Y_%m') AS ym, count(*) AS n FROM orders GROUP BY 1"),
    "known_content": (known_content, "WITH u AS (SELECT url, bool_or(page_id % 2 = 0) AS there FROM pages GROUP BY url) SELECT CASE WHEN there THEN 'there' ELSE 'gone' END AS side, count(*) AS n FROM u GROUP BY 1"),
    "unseen": (unseen, "SELECT DISTINCT sha256(text) AS record FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 100)"),
    "frozen": (frozen, """WITH t AS (SELECT DISTINCT p_type, p_name || ' ' || p_type AS term FROM part), c AS (SELECT p_type, count(*) AS n, string_agg('"' || term || '"', ',' ORDER BY term) AS terms FROM t GROUP BY p_type)
SELECT '{' || string_agg('"' || p_type || '":{"term_count":' || n || ',"terms":[' || terms || ']}', ',' ORDER BY p_type) || '}' AS dictionary FROM c"""),
}
