"""Relational shapes: first-wins unions and duplicates, priorities, tiers with drop reasons, dictionary joins, top-k."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import cells


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Order must be total for a fixed result."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("tl_at", at).filter("tl_at = 1").drop("tl_at")


def top_k(df: DataFrame, order: list[Column], k: int, key: list[str] | None = None, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows, overall (no full sort) or of each key; ``rank`` names a column for the place."""
    if key is None and rank is None:
        return df.orderBy(*order).limit(k)
    window = Window.partitionBy(*(key or [])).orderBy(*order)
    out = df.withColumn(rank or "tl_at", F.row_number().over(window)).filter(F.col(rank or "tl_at") <= k)
    return out if rank else out.drop("tl_at")


def priority_union(frames: Iterable[DataFrame], key: list[str]) -> DataFrame:
    """The union by name; of rows with one key, that of the earliest frame."""
    tagged = [f.withColumn("tl_from", F.lit(k)) for k, f in enumerate(frames)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in whole.columns if c not in (*key, "tl_from")]
    return first_by(whole, key, [F.col("tl_from"), *map(F.col, rest)]).drop("tl_from")


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(tag, F.lit(k)) for k, f in frames.items()])


def without(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def only(df: DataFrame, there: DataFrame, key: list[str]) -> DataFrame:
    return df.join(there.select(*key).distinct(), key, "left_semi")


def merged(left: DataFrame, right: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """A join in which the left side's columns win over the right side's of the same names."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in key]), key, how)


def unless_canonical(df: DataFrame, column: str, canonical: Column) -> DataFrame:
    """Drops values whose canonical form differs and is itself among the values."""
    forms = df.withColumn("tl_form", canonical)
    known = df.select(F.col(column).alias("tl_known")).distinct()
    varied = forms.filter(F.col("tl_form") != F.col(column)).join(known, F.col("tl_form") == F.col("tl_known"), "left_semi")
    return df.join(varied.select(column).distinct(), column, "left_anti")


def reasons(rules: Iterable[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules])


def all_reasons(rules: Iterable[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def tiered(df: DataFrame, drops: list[tuple[str, Column]], tiers: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows with their tier, and the counts of drop reasons (the first rule that drops a row, or no tier)."""
    marked = df.withColumn("drop_reason", reasons([*drops, ("no_tier", reasons(tiers).isNull())])).withColumn("tier", reasons(tiers))
    counts = marked.filter("drop_reason IS NOT NULL").groupBy("drop_reason").agg(F.count("*").alias("n"))
    return marked.filter("drop_reason IS NULL").drop("drop_reason"), counts


def longest_name(df: DataFrame, text: str, names: DataFrame, name: str, key: list[str]) -> DataFrame:
    """The longest dictionary name that stands in a text between non-letters, in any case (of equal ones the first).

    A name can only stand where its first word does, so texts and names are joined on words instead of compared
    each with each; the whole name is then looked for."""
    word = lambda c: F.regexp_extract(F.lower(c), "[a-z]+", 0)
    known = names.select(F.col(name).alias("tl_name")).distinct().withColumn("tl_word", word(F.col("tl_name")))
    shown = df.select(*key, text).withColumn("tl_word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))))
    padded = lambda c: F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    quoted = F.concat(F.lit(r"(?<![a-z])\Q"), F.lower("tl_name"), F.lit(r"\E(?![a-z])"))
    hits = shown.join(known, "tl_word").filter(F.contains(padded(F.col(text)), F.lower("tl_name"))).filter(F.regexp_like(F.lower(text), quoted))
    best = first_by(hits, key, [F.length("tl_name").desc(), F.col("tl_name")]).select(*key, F.col("tl_name").alias(name))
    return df.join(best, key, "left")


def wide(df: DataFrame, key: list[str], column: str, values: list[str], agg: Column, total: str | None = None) -> DataFrame:
    """A pivot over known values, missing cells as 0, with a row total on request."""
    out = df.groupBy(*key).pivot(column, values).agg(agg).fillna(0, values)
    return out.withColumn(total, reduce(lambda a, b: a + b, map(F.col, values))) if total else out


def long(df: DataFrame, key: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(key, columns, name, value)


def nearest(vectors: DataFrame, anchors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` most similar other vectors of each anchor, by cosine; of equal ones those with the smaller key.

    All pairs are scored, in cells of a part of the anchors and a part of the vectors, as products of matrices; a cell
    works out exactly, component by component, what can be among its first ``k``, and hands on no more than that. So
    what is shuffled grows with the vectors times the parts of the anchors (of ANCHORS each), and the reverse. Of the
    copies of a vector, only those of its first k + 1 keys can be wanted, and others are left out before."""

    kind, n = vectors.schema[key].dataType.simpleString(), Window.partitionBy("vector").orderBy("key")
    plain = lambda df: df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter("key IS NOT NULL")
    own, all_ = plain(anchors), plain(vectors).withColumn("tl_at", F.dense_rank().over(n)).filter(F.col("tl_at") <= k + 1).drop("tl_at")
    parts = [max(1, math.ceil(side.count() / most)) for side, most in ((own, cells.ANCHORS), (plain(vectors), cells.VECTORS))]
    part = lambda count: F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    a = own.select(part(parts[0]).alias("i"), every(parts[1]).alias("j"), F.lit(0).alias("side"), "key", "vector")
    b = all_.select(every(parts[0]).alias("i"), part(parts[1]).alias("j"), F.lit(1).alias("side"), "key", "vector")
    dealt = a.union(b).select((F.col("i") * parts[1] + F.col("j")).alias("cell"), "side", "key", "vector").repartitionById(parts[0] * parts[1], F.col("cell"))
    scored = dealt.sortWithinPartitions("cell", "side", "key").mapInArrow(cells.searched(k), f"anchor {kind}, neighbor {kind}, similarity double")
    return top_k(scored, [F.desc("similarity"), F.col("neighbor")], k, ["anchor"], "rank")


def reachable(links: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """All nodes that links (src, dst) lead to from the seeds (node), each with its depth. Every frontier is written
    once, as a partition of the nodes seen, so that no level rewrites the ones before it; cycles end where they began."""
    from textloom.sources.tables import shared_folder

    spark, kind = seeds.sparkSession, seeds.schema["node"].dataType.simpleString()
    at, depth, n_seen = f"{shared_folder(spark)}/textloom/reached-{uuid.uuid4().hex}", 0, 0
    fresh = seeds.select("node").distinct()
    while True:
        fresh.write.parquet(f"{at}/depth={depth}")
        edge = spark.read.schema(f"node {kind}").parquet(f"{at}/depth={depth}")
        seen = spark.read.schema(f"node {kind}, depth int").parquet(at)
        n = edge.count()
        n_seen += n
        if not n or (most is not None and n_seen >= most):
            return seen if most is None else top_k(seen, [F.col("depth"), F.col("node")], most)
        fresh = links.join(edge, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        depth += 1


def reachable_shallow(links: DataFrame, seeds: DataFrame, levels: int) -> DataFrame:
    """The same up to a depth, as one recursive query without tables in between: for graphs so shallow that the paths
    (not only the nodes) of ``levels`` steps are few, as the recursion follows every path."""
    walked = seeds.sparkSession.sql(
        """WITH RECURSIVE walked (node, depth) AS (SELECT DISTINCT node, 0 FROM {seeds}
        UNION ALL SELECT l.dst, w.depth + 1 FROM walked w JOIN {links} l ON l.src = w.node WHERE w.depth < {levels})
        SELECT node, min(depth) AS depth FROM walked GROUP BY node""",
        seeds=seeds.select("node"), links=links.select("src", "dst").distinct(), levels=levels,
    )
    return walked


def running(df: DataFrame, by: str, amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows before it in order of ``by`` (distinct), in parallel: ranges of
    the order are summed up alone, and each adds what the ranges before it come to (a row for each range)."""
    from textloom.sources.tables import settled

    parts = settled(df.repartitionByRange(F.col(by)).withColumn("tl_part", F.spark_partition_id()))
    sums = parts.groupBy("tl_part").agg(F.sum(amount).alias("tl_sum"))
    before = sums.select("tl_part", (F.sum("tl_sum").over(Window.orderBy("tl_part")) - F.col("tl_sum")).alias("tl_before"))
    own = F.sum(amount).over(Window.partitionBy("tl_part").orderBy(by)) - F.col(amount)
    return parts.withColumn("tl_own", own).join(F.broadcast(before), "tl_part").withColumn(name, F.col("tl_before") + F.col("tl_own")).drop("tl_part", "tl_own", "tl_before")
