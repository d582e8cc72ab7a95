"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weighted share of the mix, capped at ``most`` times what it has; the excess goes to the
others by weight until none is above its cap. Of a target, every document first gets the whole copies that are
certain; the rest is a sample of unequal inclusion probability: documents are ranked by their random odds over
their inclusion odds, u / (1 - u) / (p / (1 - p)), and taken in that order until the words of the rest are
reached, so the sample has a fixed size in words (to within half a document). Probabilities fall with the square
root of the size class (floor of log2), so that short documents are preferred to few long ones; a class whose
probability reaches 1 is taken whole before the lottery.

The random number of a document is a hash of its id and text, so reruns agree on any cluster. A hot source is no
task of its own: class and bucket sums are combined before they are shuffled, and only the rows of the one bucket
that holds a source's cut are put in order.

Defined results: a null text has size 0 and takes nothing; the null source is a source, last in order; repeated
rows are separate documents; an empty table gives an empty one. Columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, quoted, stored, table, unused

BUCKETS = 1 << 14
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` with its rank (from 0) in the order of ``by``, without bringing all rows to one task."""
    parts = stored(df.repartitionByRange(*by).withColumn("tl_part", F.spark_partition_id()), name)
    before = parts.groupBy("tl_part").agg(F.count("*").alias("tl_n")).select("tl_part", (F.sum("tl_n").over(Window.orderBy("tl_part")) - F.col("tl_n")).alias("tl_before"))
    at = F.row_number().over(Window.partitionBy("tl_part").orderBy(*by)) - 1
    return parts.join(F.broadcast(before), "tl_part").withColumn(name, at + F.col("tl_before")).drop("tl_part", "tl_before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(tl_source, tl_source_size) with the target of each source, as ``tl_target``."""
    order = [F.col("tl_source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("tl_rank") % len(weights) + 1).cast("int"))
    sources = stored(ranked(sizes, order, "tl_rank").select("tl_source", "tl_source_size", weight.alias("tl_weight")), "sources")
    cap = F.col("tl_source_size") * most
    wanted = sources.agg(F.sum("tl_source_size")).first()[0] or 0
    level, capped = None, -1
    while True:  # each round caps one more source at least, in practice a few rounds in all
        over = F.lit(False) if level is None else F.col("tl_weight") * level > cap
        fixed, rest, n = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("tl_weight"))), F.count_if(over)).first()
        if n == capped or not rest:
            break
        level, capped = (wanted * share - (fixed or 0.0)) / rest, n
    target = F.least(F.col("tl_weight") * F.lit(level or 0.0), cap)
    return sources.select("tl_source", "tl_source_size", target.alias("tl_target"))


ADDED = ("tl_size", "tl_source_size", "tl_target", "tl_copies")


def with_copies(docs: DataFrame, size: Column, source: Column, identity: list[Column], **mix) -> DataFrame:
    """``docs`` with tl_size, tl_source_size, tl_target and tl_copies (how often the mix takes the row); such a column's
    name is marked with an underscore where ``docs`` has it."""
    return copied(docs, size, source, identity, **mix).toDF(*docs.columns, *[unused(c, docs.columns) for c in ADDED])


def copied(docs: DataFrame, size: Column, source: Column, identity: list[Column], **mix) -> DataFrame:
    """``docs`` under the names c0, c1 and so on, which no name of this module's clashes with, and ADDED."""
    own = [f"c{k}" for k in range(len(docs.columns))]
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("pareto"), *identity), 11).cast("double") + 0.5) / float(1 << 53)
    made = {"tl_size": size, "tl_source": source, "tl_u": u, "tl_row": F.monotonically_increasing_id(), "tl_class": F.floor(F.log2(size + 1)).cast("int")}
    rows = stored(docs.select(*map(quoted, docs.columns), *made.values()).toDF(*own, *made), "mix")

    classes = rows.groupBy("tl_source", "tl_class").agg(F.sum("tl_size").alias("tl_words"))
    classes = stored(classes, "classes")
    goals = targets(classes.groupBy("tl_source").agg(F.sum("tl_words").alias("tl_source_size")), **mix)
    whole = F.when(F.col("tl_source_size") > 0, F.floor(F.col("tl_target") / F.col("tl_source_size") + 1e-12)).otherwise(0)
    goals = goals.withColumn("tl_whole", whole.cast("int")).withColumn("tl_rest", F.greatest(F.lit(0.0), F.col("tl_target") - F.col("tl_whole") * F.col("tl_source_size")))
    goals = stored(goals, "goals")

    # The level c of a source: p = min(1, c * lean) over its classes (at most 64), with sum(words * p) = rest.
    lean = F.pow(F.lit(2.0), -F.col("tl_class") / 2)
    up = Window.partitionBy("tl_source").orderBy("tl_class")
    per_class = classes.join(goals.hint("merge"), classes["tl_source"].eqNullSafe(goals["tl_source"])).drop(goals["tl_source"])
    per_class = per_class.withColumns({"tl_lean": lean, "tl_below": F.sum("tl_words").over(up) - F.col("tl_words"), "tl_above": F.sum(F.col("tl_words") * lean).over(Window.partitionBy("tl_source").orderBy(F.col("tl_class").desc()))})
    level = F.when(F.col("tl_above") > 0, (F.col("tl_rest") - F.col("tl_below")) / F.col("tl_above"))
    fits = per_class.withColumn("tl_c", level).filter(F.col("tl_c") * F.col("tl_lean") <= 1)
    levels = fits.groupBy("tl_source").agg(F.max(F.struct(-F.col("tl_class"), "tl_c"))["tl_c"].alias("tl_c"))
    odds = goals.join(levels, goals["tl_source"].eqNullSafe(levels["tl_source"]), "left").drop(levels["tl_source"])
    odds = stored(odds.withColumn("tl_c", F.greatest(F.lit(0.0), F.coalesce("tl_c", F.lit(0.0)))), "odds")
    few = odds.count() <= BROADCAST_ROWS
    sided = lambda t: F.broadcast(t) if few else t

    p = F.least(F.lit(1.0), F.col("tl_c") * lean)
    ratio = F.col("tl_u") / (1 - F.col("tl_u")) * (1 - p) / p
    drawn = rows.join(sided(odds), rows["tl_source"].eqNullSafe(odds["tl_source"])).drop(odds["tl_source"])
    drawn = drawn.withColumns({"tl_p": p}).withColumns({"tl_rank": F.when(F.col("tl_p") >= 1 - 1e-12, -1.0).when(F.col("tl_p") > 0, ratio / (1 + ratio)).otherwise(2.0)})
    drawn = drawn.withColumn("tl_bucket", F.floor(F.col("tl_rank") * BUCKETS).cast("int"))

    # The bucket in which a source's words reach the rest, from sums; then the rows of that bucket alone, in order.
    by_bucket = drawn.filter("tl_rank < 2").groupBy("tl_source", "tl_bucket").agg(F.sum("tl_size").alias("tl_words"), F.first("tl_rest").alias("tl_rest"))
    reach = F.sum("tl_words").over(Window.partitionBy("tl_source").orderBy("tl_bucket"))
    cuts = by_bucket.withColumn("tl_reach", reach).filter("tl_reach >= tl_rest AND tl_reach - tl_words < tl_rest")
    cuts = stored(cuts.groupBy("tl_source").agg(F.min(F.struct("tl_bucket", (F.col("tl_reach") - F.col("tl_words")).alias("tl_before"))).alias("tl_cut")).select("tl_source", "tl_cut.*").withColumnsRenamed({"tl_bucket": "tl_at"}), "cuts")
    edge = drawn.select("tl_source", "tl_bucket", "tl_rank", "tl_row", "tl_size", "tl_rest").join(sided(cuts), drawn["tl_source"].eqNullSafe(cuts["tl_source"])).drop(cuts["tl_source"]).filter("tl_bucket = tl_at")
    before = F.col("tl_before") + F.sum("tl_size").over(Window.partitionBy("tl_source").orderBy("tl_rank", "tl_row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tl_size")
    last = edge.withColumn("tl_so_far", before).filter("tl_rest - tl_so_far >= tl_size / 2.0").groupBy("tl_source").agg(F.max(F.struct("tl_rank", "tl_row")).alias("tl_last"))
    ends = cuts.join(last, cuts["tl_source"].eqNullSafe(last["tl_source"]), "left").drop(last["tl_source"])
    ends = stored(ends, "ends")

    full = drawn.join(sided(ends), drawn["tl_source"].eqNullSafe(ends["tl_source"]), "left").drop(ends["tl_source"])
    inside = F.when(F.col("tl_at").isNull(), F.col("tl_rank") < 2).when(F.col("tl_bucket") != F.col("tl_at"), F.col("tl_bucket") < F.col("tl_at")).otherwise(F.coalesce(F.struct("tl_rank", "tl_row") <= F.col("tl_last"), F.lit(False)))
    copies = F.when(F.col("tl_rest") > 0, F.col("tl_whole") + inside.cast("int")).otherwise(F.col("tl_whole"))
    return full.withColumn("tl_copies", copies).select(*own, *ADDED)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mix) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    taken = copied(docs, word_count(quoted(text_col)), quoted(source_col), [quoted(id_col), quoted(text_col)], **mix)
    own = taken.columns[: len(docs.columns)]
    return taken.filter("tl_copies > 0").withColumn("tl_copy", F.explode(F.sequence(F.lit(1), "tl_copies"))).select(*own).toDF(*docs.columns)


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text"))
    taken = with_copies(docs, F.col("size"), F.col("source"), [F.col("doc_id"), F.col("text")])
    return taken.select("doc_id", F.col("tl_size").alias("size"), F.col("tl_source_size").alias("source_size"), F.col("tl_target").alias("target"), (F.col("tl_size") * F.col("tl_copies")).alias("taken"))
