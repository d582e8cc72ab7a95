"""The page parsers as table functions for ``LATERAL`` joins in SQL and ``lateralJoin`` of DataFrames: each row's
other columns stay beside what is generated from it, and batches travel by Arrow.

A null text gives no row, but for ``record_parts``, where it is one empty record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import before_marker, content_key, number_after, rebuilt, title_of
from textloom.operators import html as pages


@F.udtf(returnType="day string, part int, fragment string", useArrow=True)
class DayFragments:
    """``day_fragments(html, headers)``: the fragments between date headers (an array of patterns)."""

    def eval(self, html, headers):
        for k, (day, fragment) in enumerate(pages.day_fragments(html, tuple(headers))):
            yield day, k, fragment


@F.udtf(returnType="text string", useArrow=True)
class RecordCells:
    """``record_cells(fragment, markers, mark, least)``: the texts of cells that hold all markers (an array)."""

    def eval(self, fragment, markers, mark, least):
        for text in pages.record_cells(fragment, tuple(markers), mark, least):
            yield (text,)


@F.udtf(returnType="part int, of int, piece string", useArrow=True)
class RecordParts:
    """``record_parts(text, ends, starts, most, least)``: a text of several records as a row for each, with their number."""

    def eval(self, text, ends, starts, most, least):
        parts = pages.record_parts(text, ends, starts, most, least)
        for k, piece in enumerate(parts):
            yield k, len(parts), piece


@F.udtf(returnType="dst string, label string", useArrow=True)
class PageLinks:
    """``page_links(url, html)``: the distinct resolved links of a page."""

    def eval(self, url, html):
        yield from pages.labelled_links(url, html).items()


@F.udtf(returnType="dst string, fragment string, label string, text string", useArrow=True)
class IndexLinks:
    """``index_links(url, html, host, sidebar)``: dated links with the text around them, before it is tidied."""

    def eval(self, url, html, host, sidebar):
        yield from pages.dated_links(url, html, host, sidebar, r"\d{6}")


FUNCTIONS = {"day_fragments": DayFragments, "record_cells": RecordCells, "record_parts": RecordParts, "page_links": PageLinks, "index_links": IndexLinks}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


def cleaned_records(rows: DataFrame, ends: str, starts: str, markers: tuple[str, ...], score: str, name: str = "name", text: str = "text", most: int = 6, least: int = 80) -> DataFrame:
    """Rows cut into their records, each with its own title, rebuilt text, score and content key; other columns stay.

    A record without a title of its own takes the row's name, if the row is a single record. Records whose title has
    fewer than two characters are dropped."""
    cut = rows.lateralJoin(RecordParts(F.col(text).outer(), F.lit(ends), F.lit(starts), F.lit(most), F.lit(least)))
    head = lambda c: title_of(before_marker(c, markers))["title"]
    given = F.coalesce(F.trim(F.col(name)), F.lit(""))
    fallback = F.when(F.col("of") == 1, F.coalesce(F.nullif(head(given), F.lit("")), given)).otherwise("")
    titled = cut.withColumn("tl_title", F.coalesce(F.nullif(head(F.col("piece")), F.lit("")), fallback)).filter(F.length("tl_title") >= 2)
    whole = titled.withColumn("tl_text", rebuilt(F.col("piece"), F.col("tl_title"), markers))
    made = {name: F.col("tl_title"), text: F.col("tl_text"), "score": number_after(F.col("tl_text"), score), "content_key": content_key(F.col("tl_text"))}
    others = [c for c in rows.columns if c not in made]
    return whole.select(*[F.col(f"`{c}`") for c in others], "part", *[c.alias(n) for n, c in made.items()])


def parsed_by(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A query over frames by name, with the table functions registered."""
    register(spark)
    return spark.sql(sql, **tables)

