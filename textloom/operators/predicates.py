"""Row tests and recodings: structure gates, cues with precedence, thresholds by quantile, classes, list building."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import blank, squeezed, stars
from textloom.operators.relational import first_by, priority_union, without
from textloom.operators.selection import exact_quantiles


def whole_number(text: Column) -> Column:
    """Whether a trimmed text is digits alone."""
    return F.trim(blank(text)).rlike(r"^\d+$")


def all_in(text: Column, groups: Iterable[tuple[str, ...]]) -> Column:
    """Whether of each group of markers one at least is in the text, in its case."""
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains(blank(text), F.lit(m)) for m in g]) for g in groups])


def any_rule(text: Column, rules: Iterable[tuple[str, ...]]) -> Column:
    """Whether all phrases of some rule are in the text, in any case."""
    low = F.lower(blank(text))
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(low, F.lit(p.lower())) for p in rule]) for rule in rules])


def record_like(text: Column, groups: Iterable[tuple[str, ...]], noise: Iterable[tuple[str, ...]] = (), least: int = 80) -> Column:
    """The structure of a record: its markers, a least length, and none of the noise rules."""
    ok = all_in(text, groups) & (F.length(squeezed(blank(text))) >= least)
    return ok & ~any_rule(text, noise) if noise else ok


def starts_with_any(text: Column, heads: Iterable[str]) -> Column:
    low = F.lower(F.trim(blank(text)))
    return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(h)) for h in heads])


def cues(text: Column, ordered: Iterable[tuple[str, str]]) -> Column:
    """The first cue whose pattern matches; a later one does not count beside it."""
    return F.coalesce(*[F.when(blank(text).rlike(f"(?i){p}"), F.lit(name)) for name, p in ordered])


def above_quantile(df: DataFrame, tests: dict[str, float], name: str = "above") -> DataFrame:
    """Whether all columns exceed their own quantile over the whole table (one row, broadcast)."""
    long = df.select([F.col(c).cast("double").alias(c) for c in tests]).unpivot([], list(tests), "variable", "value")
    found = exact_quantiles(long, "value", tests.values(), ["variable"])
    cuts = found.agg(*[F.max(F.when(F.col("variable") == c, F.col("quantiles")[k])).alias(f"tl_{c}") for k, c in enumerate(tests)])
    test = reduce(lambda a, b: a & b, [F.col(c) > F.col(f"tl_{c}") for c in tests])
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, F.coalesce(test, F.lit(False))).drop(*[f"tl_{c}" for c in tests])


def complete(df: DataFrame, counts: list[str]) -> DataFrame:
    """Rows in which every count is positive."""
    return df.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in counts]))


def recoded(value: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.trim(blank(value))], F.lit(default))


def page_kind(url: Column, kinds: dict[str, tuple[str, ...]], default: str = "other") -> Column:
    """A page's kind by the base name of its link."""
    base = F.lower(F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1))
    return F.coalesce(*[F.when(base.isin(*names), F.lit(k)) for k, names in kinds.items()], F.lit(default))


def link_year(url: Column, pattern: str = r"(\d{2})-\d+\.html", pivot: int = 70) -> Column:
    yy = F.regexp_extract(url, pattern, 1).try_cast("int")
    return F.when(yy >= pivot, yy + 1900).otherwise(yy + 2000)


def in_years(url: Column, low: int | None = None, high: int | None = None) -> Column:
    """Unknown years pass only where no bound is set."""
    if low is None and high is None:
        return F.lit(True)
    return F.coalesce(link_year(url).between(low or 0, high or 9999), F.lit(False))


def cell(b: Column, se: Column, p: Column, digits: int = 3) -> Column:
    """A coefficient with its stars and its standard error in brackets."""
    return F.concat(F.format_number(b, digits), stars(p), F.lit(" ("), F.format_number(se, digits), F.lit(")"))


def pair_filter(pairs: DataFrame, curated: DataFrame, stopwords: list[str], filler: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Word pairs with why each is dropped: a curated phrase has the same words, both are stop words, or a filler."""
    words = F.array_sort(F.array(a, b))
    known = curated.select(F.array_sort(F.split("phrase", "[ _]")).alias("tl_words")).distinct().withColumn("tl_known", F.lit(True))
    marked = pairs.withColumn("tl_own", words).join(known, F.col("tl_own") == F.col("tl_words"), "left")
    why = F.when(F.col("tl_known"), "curated").when(F.col(a).isin(stopwords) & F.col(b).isin(stopwords), "stopwords").when(F.col(a).isin(filler) | F.col(b).isin(filler), "filler")
    return marked.withColumn("dropped_because", why).drop("tl_own", "tl_words", "tl_known")


def left_unjoined(df: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """For each phrase the number of texts in which its spaced form is left."""
    spaced = {p: r"(?i)\b" + p.replace("_", r"\s+") + r"\b" for p in phrases}
    one = df.agg(*[F.count_if(blank(F.col(text)).rlike(r)).alias(p) for p, r in spaced.items()])
    return one.unpivot([], phrases, "phrase", "n_left")


def in_order(frames: list[DataFrame], column: str, place: str) -> DataFrame:
    """Values of lists one after the other, each at its first place."""
    tagged = reduce(DataFrame.unionByName, [f.select(column, F.struct(F.lit(k).alias("list"), F.col(place).alias("at")).alias("place")) for k, f in enumerate(frames)])
    return first_by(tagged, [column], [F.col("place")])


def best_category(df: DataFrame, term: str, category: str, value: str) -> DataFrame:
    """For each term the category of its largest value, the first by name of equal ones."""
    return first_by(df, [term], [F.desc(value), F.col(category)])


def final_terms(seed: DataFrame, expansion: DataFrame, resolved: DataFrame, category: str, least: int = 10) -> DataFrame:
    """A category's terms: frequent seeds, expansions and terms resolved to it, but none resolved to another."""
    own, other = resolved.filter(F.col("category") == category), resolved.filter(F.col("category") != category)
    kept = priority_union([seed.filter(F.col("frequency") >= least).select("term"), expansion.select("term"), own.select("term")], ["term"])
    return without(kept, other, ["term"])


def thin_pages(records: DataFrame, pages: DataFrame, key: str = "url", least: int = 2) -> DataFrame:
    """Pages with fewer records than expected, those without any included."""
    n = records.groupBy(key).agg(F.count("*").alias("n"))
    return pages.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < least)


def simple_effect(df: DataFrame, group: Column, measures: list[str], digits: int = 6) -> DataFrame:
    """Cohen's d with the plain mean of the two variances, the older variant."""
    g = F.coalesce(group, F.lit(False))
    parts = [F.struct(F.lit(m).alias("measure"), *[f(F.when(g == side, F.col(m))).alias(f"{n}{int(side)}") for side in (True, False) for n, f in (("m", F.avg), ("v", F.var_samp))]) for m in measures]
    one = df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("x")).select("x.*")
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return one.select("measure", F.round(F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled), digits).alias("d"))


def widest_mean(df: DataFrame, category: str, section: str, value: str) -> DataFrame:
    """The section in which each category's mean is largest."""
    means = df.groupBy(category, section).agg(F.avg(value).alias("mean"))
    return first_by(means, [category], [F.desc("mean"), F.col(section)])


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy()))
