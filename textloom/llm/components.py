"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import dropped, stored

#: Tasks that the rows of one key are dealt to, at most.
SALTS = 64


def salted(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with tl_salt, one of SALTS numbers by a hash of ``by``, the column that tells the rows of a key apart."""
    return rows.withColumn("tl_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def looked_up(rows: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """The inner join of ``rows`` (many a ``key``) with ``values`` (a row for each). Rows of a key are dealt by salt, and
    a value is copied only for the salts that its key has, so a hot key is in SALTS tasks and there are never more
    copies than rows."""
    dealt = salted(rows, by)
    salts = dealt.select(key, "tl_salt").distinct()
    return dealt.join(values.join(salts, key), [key, "tl_salt"]).drop("tl_salt")


def nearest(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the least neighbour of u, itself included, as m. The minimum is taken by salt, then by u,
    and comes back to the salts that u has, as in ``looked_up``."""
    dealt = salted(edges, "v")
    least = dealt.groupBy("u", "tl_salt").agg(F.min("v").alias("m")).groupBy("u").agg(F.least("u", F.min("m")).alias("m"), F.collect_list("tl_salt").alias("salts"))
    return dealt.join(least.select("u", "m", F.explode("salts").alias("tl_salt")), ["u", "tl_salt"]).select("u", "v", "m")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = nearest(down)
    return linked.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for each node of ``edges`` (u, v) but the least of its component, v is that least node.

    Each round is written to the shared folder; rounds grow with the logarithm of the size of a component.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now
        seen, before = tuple(mark), now
        now = stored(small_star(large_star(now)), "edges")
        dropped(before)
