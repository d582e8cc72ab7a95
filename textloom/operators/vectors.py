"""Word-vector geometry: axes, projections, association tests with exact permutations, stability."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.values import cosine, dot, norm, unit
from textloom.sources.tables import settled

#: Up to so many partitions a test is exact.
EXACT = 10_000


def mean_vector(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Componentwise means of a vector column for each group."""
    parts = df.select(*by, F.posexplode(vector).alias("tl_at", "tl_x")).groupBy(*by, "tl_at").agg(F.avg("tl_x").alias("tl_x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("tl_at", "tl_x"))), lambda p: p["tl_x"]).alias(vector))


def axes(vectors: DataFrame, poles: DataFrame, term: str = "term", vector: str = "vector", least: int = 2) -> DataFrame:
    """Unit axes (dimension, axis) from the means of unit vectors of positive and negative poles (dimension, sign,
    term). A pole with fewer than ``least`` known terms is an error."""
    own = poles.join(vectors.select(F.col(term).alias("tl_term"), unit(F.col(vector)).alias("tl_v")), F.col("term") == F.col("tl_term"))
    counts = poles.select("dimension", "sign").distinct().join(own.groupBy("dimension", "sign").agg(F.count("*").alias("n")), ["dimension", "sign"], "left").filter(F.coalesce("n", F.lit(0)) < least)
    if short := counts.take(1):
        raise ValueError(f"pole {short[0]['sign']} of {short[0]['dimension']} has fewer than {least} known terms")
    means = mean_vector(own.select("dimension", "sign", "tl_v"), ["dimension", "sign"], "tl_v")
    a = means.filter("sign > 0").select("dimension", F.col("tl_v").alias("p"))
    b = means.filter("sign < 0").select(F.col("dimension").alias("d"), F.col("tl_v").alias("q"))
    return a.join(b, F.col("dimension") == F.col("d")).select("dimension", unit(F.zip_with("p", "q", lambda x, y: x - y)).alias("axis"))


def projected(vectors: DataFrame, on: DataFrame, term: str = "term", vector: str = "vector") -> DataFrame:
    """The cosine of every term with every axis; axes are few, and are broadcast."""
    return vectors.crossJoin(F.broadcast(on)).select(term, "dimension", cosine(F.col(vector), F.col("axis")).alias("projection"))


def category_means(projections: DataFrame, terms: DataFrame, poles: DataFrame, term: str = "term") -> tuple[DataFrame, DataFrame]:
    """Category means of projections without each dimension's own pole terms, and the register of what was left out."""
    rows = projections.join(terms.select("category", F.col("term").alias("tl_term")), F.col(term) == F.col("tl_term")).drop("tl_term")
    ends = poles.select("dimension", F.col("term").alias(term)).distinct().withColumn("is_pole", F.lit(True))
    marked = rows.join(ends, ["dimension", term], "left").withColumn("is_pole", F.coalesce("is_pole", F.lit(False)))
    kept = marked.filter(~F.col("is_pole")).groupBy("category", "dimension").agg(F.avg("projection").alias("mean"), F.count("*").alias("n"))
    register = marked.groupBy("category", "dimension").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_pole"), F.col(term)))), "; ").alias("excluded"), F.count_if("is_pole").alias("n_excluded"), F.count_if(~F.col("is_pole")).alias("n_retained")).filter("n_excluded > 0")
    return kept, register


def weighted_means(projections: DataFrame, frequencies: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    own = frequencies.dropDuplicates(["term"]).select(F.col("term").alias("tl_term"), "frequency")
    rows = projections.join(terms.select("category", F.col("term").alias("tl_t")), F.col(term) == F.col("tl_t")).join(own, F.col(term) == F.col("tl_term"), "left")
    w = F.coalesce("frequency", F.lit(0))
    return rows.groupBy("category", "dimension").agg(F.when(F.sum(w) > 0, F.sum(w * F.col("projection")) / F.sum(w)).alias("weighted_mean"))


def associations(targets: DataFrame, attributes: DataFrame, term: str = "term", vector: str = "vector") -> DataFrame:
    """(term, side, s): mean cosine with attribute set A less that with B, as the mean over a set is the product with
    the mean of its unit vectors; a vector without direction has no cosine. Any number of targets and attributes."""
    scale = F.try_divide(F.lit(1.0), norm(F.col(vector)))
    parts = attributes.select("set", scale.alias("tl_scale"), F.posexplode(vector).alias("tl_at", "tl_x")).filter(F.col("set").isin("A", "B") & F.col("tl_scale").isNotNull())
    sums = parts.groupBy("tl_at").agg(*(F.avg(F.when(F.col("set") == x, F.col("tl_x") * F.col("tl_scale"))).alias(x) for x in "AB"))
    listed = sums.agg(F.array_sort(F.collect_list(F.struct("tl_at", "A", "B"))).alias("tl_l"))
    lean = listed.select(F.transform("tl_l", lambda x: x["A"] - x["B"]).alias("tl_lean"))  # one row
    each = targets.crossJoin(F.broadcast(lean)).select(term, "side", (dot(F.col(vector), F.col("tl_lean")) * scale).alias("s"))
    return each.groupBy(term, "side").agg(F.avg("s").alias("s"))


def association_test(targets: DataFrame, attributes: DataFrame, term: str = "term", vector: str = "vector", exact: int = EXACT, samples: int = 10_000, seed: int = 42) -> dict:
    """The effect (difference of means over the pooled sd) and the one-sided p, (extreme + 1) / (partitions + 1), over
    all equal splits of the targets if they are few, else over random ones. Overlapping sets are an error."""
    rows = associations(targets, attributes, term, vector).orderBy("side", term).collect()  # the terms of one test
    if len({r[term] for r in rows}) < len(rows):
        raise ValueError("target sets overlap")
    s = np.array([r["s"] for r in rows])
    k, n = sum(r["side"] == "X" for r in rows), len(rows)
    whole = s[:k].sum() - s[k:].sum()
    if math.comb(n, k) <= exact:
        picks = np.array(list(itertools.combinations(range(n), k)))
    else:
        r = np.random.default_rng(seed)
        picks = np.array([r.permutation(n)[:k] for _ in range(samples)])
    sums = 2 * s[picks].sum(axis=1) - s.sum()
    extreme = int((sums >= whole - 1e-12).sum())
    return {"effect": float((s[:k].mean() - s[k:].mean()) / s.std(ddof=1)), "p": (extreme + 1) / (len(picks) + 1), "n_permutations": len(picks)}


def shuffle_test(scores: DataFrame, shuffles: int = 10_000, seed: int = 42) -> dict:
    """The plain variant on (side, s): the difference of means, and the share of shuffles that reach it (extreme / shuffles)."""
    rows = scores.orderBy("side", "s").collect()  # the terms of one test
    s, x = np.array([r["s"] for r in rows]), np.array([r["side"] == "X" for r in rows])
    own, r, extreme = s[x].mean() - s[~x].mean(), np.random.default_rng(seed), 0
    for _ in range(shuffles):
        mixed = r.permutation(s)
        extreme += mixed[x].mean() - mixed[~x].mean() >= own
    return {"difference": float(own), "p": extreme / shuffles, "n_permutations": shuffles}


def primaries_adjusted(tests: DataFrame) -> DataFrame:
    """Tests (name, role, p) with the primary ones' adjusted p; the others' is null."""
    from textloom.operators.stats import holm

    main = holm(tests.filter("role = 'primary'"), "p", None, ["name"])
    return main.unionByName(tests.filter("role <> 'primary'").withColumn("p_holm", F.lit(None).cast("double")))


def exact_permutations(scores: DataFrame, by: str | None = None) -> DataFrame:
    """The same test as a query, for up to about 20 targets (side, s): masks of k bits out of n, summed and compared."""
    base = scores.agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("side") == "X", 0).otherwise(1).alias("o"), "s"))).alias("l"), F.count_if(F.col("side") == "X").cast("int").alias("k"), F.count("*").cast("int").alias("n"))
    masks = base.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.col("n")).cast("long") - 1))).filter(F.bit_count("mask") == F.col("k"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    part = total(F.transform("l", lambda x, j: F.when(F.expr("mask").bitwiseAND(F.pow(F.lit(2), j).cast("long")) > 0, x["s"]).otherwise(0.0)))
    own = total(F.transform("l", lambda x: F.when(x["o"] == 0, x["s"]).otherwise(0.0)))
    return masks.agg(F.count("*").alias("n_permutations"), ((F.count_if(part >= own - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


#: A replicate's hashes below the one that ends side X are as good as certain outside so many standard deviations.
CERTAIN = 6


def sampled_permutations(scores: DataFrame, replicates: int = 2000, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """The test on (term, side, s) by random splits, for any number of targets and, with ``by``, of tests at once.

    A replicate orders a test's terms by the hash of seed, replicate and term, and takes as many as side X has. Terms are
    told apart by ``term``; a test with an empty side has no rows. p counts the own split, (extreme + 1) / (n + 1).

    Hashes are even, so where the order is cut is known but for a narrow band: what lies below it is summed up, only the
    band is sorted. Should a cut lie elsewhere, all hashes are a band."""
    by = list(by)
    tests = scores.groupBy(*by).agg(F.count_if(F.col("side") == "X").alias("tl_k"), F.count("*").alias("tl_n"), F.sum(F.when(F.col("side") == "X", F.col("s"))).alias("tl_own")).filter("tl_k > 0 AND tl_k < tl_n")

    def split(certain: float) -> DataFrame:
        share = F.col("tl_k") / F.col("tl_n")
        wide = certain * F.sqrt(share * (1 - share) / F.col("tl_n")) + 2 * certain / F.col("tl_n")
        digits = lambda x: F.lower(F.lpad(F.hex((x * float(1 << 52)).cast("long")), 13, "0"))
        low, high = F.when(share > wide, digits(share - wide)).otherwise(""), F.when(share + wide < 1, digits(share + wide)).otherwise("g")
        cuts = tests.withColumns({"tl_low": low, "tl_high": high})
        sized = scores.select(*by, "term", "s").join(cuts, by) if by else scores.select("term", "s").crossJoin(F.broadcast(cuts))  # one row
        each = sized.withColumn("tl_r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        drawn = each.withColumn("tl_drawn", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tl_r").cast("string"), F.col("term").cast("string"))))
        below = F.col("tl_drawn") < F.col("tl_low")
        sums = drawn.groupBy(*by, "tl_r").agg(F.first("tl_k").alias("tl_k"), F.first("tl_own").alias("tl_own"), F.count_if(below).alias("tl_in"), F.sum(F.when(below, F.col("s")).otherwise(0.0)).alias("tl_sum"))
        order = Window.partitionBy(*by, "tl_r").orderBy("tl_drawn", "term")
        band = drawn.filter(~below & (F.col("tl_drawn") < F.col("tl_high"))).select(*by, "tl_r", "s", F.row_number().over(order).alias("tl_at"))
        taken = band.join(sums.select(*by, "tl_r", (F.col("tl_k") - F.col("tl_in")).alias("tl_left")), [*by, "tl_r"]).groupBy(*by, "tl_r").agg(F.count("*").alias("tl_band"), F.sum(F.when(F.col("tl_at") <= F.col("tl_left"), F.col("s")).otherwise(0.0)).alias("tl_more"))
        found = sums.join(taken, [*by, "tl_r"], "left")
        inside = F.col("tl_k").between(F.col("tl_in"), F.col("tl_in") + F.coalesce("tl_band", F.lit(0)))
        return settled(found.select(*by, "tl_own", (F.col("tl_sum") + F.coalesce("tl_more", F.lit(0.0))).alias("tl_part"), inside.alias("tl_inside")))

    parts = split(CERTAIN)
    if not parts.filter("NOT tl_inside").isEmpty():
        parts = split(math.inf)
    n = F.count("*")
    return parts.groupBy(*by).agg(n.alias("n_permutations"), ((F.count_if(F.col("tl_part") >= F.col("tl_own") - 1e-12) + 1) / (n + 1)).alias("p"))


def permuted(scores: DataFrame, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """All splits of the targets if there are no more of them than replicates, else random ones."""
    n, k = scores.agg(F.count("*"), F.count_if(F.col("side") == "X")).first()
    return exact_permutations(scores) if n <= 20 and math.comb(n, k) <= replicates else sampled_permutations(scores, replicates, seed)


def audited(vocabulary: DataFrame, lists: DataFrame, term: str = "term") -> DataFrame:
    """For each list (name, term): how many terms are known, and which are not."""
    known = vocabulary.select(F.col(term).alias("tl_known")).distinct()
    rows = lists.join(known, F.col("term") == F.col("tl_known"), "left")
    return rows.groupBy("name").agg(F.count_if(F.col("tl_known").isNotNull()).alias("n_known"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("tl_known").isNull(), F.col("term")))), "; ").alias("missing"))


def raw_dot(a: Column, b: Column) -> Column:
    """The unnormalised projection."""
    from textloom.functions.values import dot

    return dot(a, b)
