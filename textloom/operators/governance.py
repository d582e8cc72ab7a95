"""Dictionary adjudication and quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import blank, snippet, term_pattern
from textloom.functions.values import padded
from textloom.operators.relational import all_reasons, priority_union, unless_canonical, without
from textloom.operators.selection import exact_quantiles

WORKSHEET = ("term", "proposed_category", "review_frequency", "status", "decision", "rationale")


def marker_counts(stages: dict[str, DataFrame], scopes: list[str], markers: dict[str, str]) -> DataFrame:
    """How many rows match each marker at least once, for each stage and scope: one pass over each stage."""
    parts = []
    for stage, df in stages.items():
        one = df.agg(*[F.count_if(blank(F.col(s)).rlike(p)).alias(f"{s}|{m}") for s in scopes for m, p in markers.items()])
        long = one.unpivot([], one.columns, "cell", "n")
        parts.append(long.select(F.lit(stage).alias("stage"), F.split("cell", r"\|")[0].alias("scope"), F.split("cell", r"\|")[1].alias("marker"), "n"))
    return reduce(DataFrame.unionByName, parts)


def gate(counts: DataFrame, stage: str, scope: str) -> None:
    """Raises if a marker is left in a stage's scope."""
    left = counts.filter((F.col("stage") == stage) & (F.col("scope") == scope) & (F.col("n") > 0)).orderBy(F.desc("n"), "marker").take(5)
    if left:
        raise ValueError("markers left: " + ", ".join(f"{r['marker']} ({r['n']})" for r in left))


def summary(df: DataFrame, key: str, score: str, year: str, scopes: list[str]) -> DataFrame:
    """One row: rows, distinct keys, score statistics, years and filled scopes."""
    filled = [F.count_if(F.trim(blank(F.col(s))) != "").alias(f"n_{s}") for s in scopes]
    sums = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"), F.round(F.avg(score), 3).alias("score_mean"), F.round(F.stddev_samp(score), 3).alias("score_sd"), F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.min(year).alias("year_min"), F.max(year).alias("year_max"), *filled)
    median = exact_quantiles(df, score, [0.5]).agg(F.round(F.max(F.col("quantiles")[0]), 3).alias("score_median"))
    return sums.crossJoin(F.broadcast(median))  # a row each


def usage(texts: DataFrame, key: str, text: str, terms: DataFrame, snippets: int = 3) -> DataFrame:
    """For each term (few, broadcast): the number of texts it stands in, and the first snippets in order of key."""
    listed = [r["term"] for r in terms.select("term").distinct().orderBy("term").collect()]
    lower = F.lower(blank(F.col(text)))
    hits = texts.select(key, F.explode(F.array_compact(F.array(*[F.when(lower.rlike(term_pattern(t)), F.struct(F.lit(t).alias("term"), snippet(lower, term_pattern(t)).alias("snippet"))) for t in listed]))).alias("h")).select(key, "h.*")
    first = F.row_number().over(Window.partitionBy("term").orderBy(key))
    counted = hits.groupBy("term").agg(F.count("*").alias("frequency"))
    shown = hits.withColumn("nth", first).filter(F.col("nth") <= snippets).groupBy("term").agg(padded(F.transform(F.array_sort(F.collect_list(F.struct("nth", "snippet"))), lambda s: s["snippet"]), snippets).alias("snippets"))
    return counted.join(shown, "term")


def candidates(prior: DataFrame, expansion: DataFrame, excluded: DataFrame, canonical: Column, ambiguous: list[tuple[str, Column]]) -> DataFrame:
    """Candidate terms: prior ones win over expansions, design exclusions go, variants go where their canonical form
    is listed; each is flagged as ambiguous by the first rule that holds."""
    terms = unless_canonical(without(priority_union([prior, expansion], ["term"]), excluded, ["term"]), "term", canonical)
    return terms.withColumn("ambiguous_because", F.coalesce(*[F.when(test, F.lit(name)) for name, test in ambiguous]) if ambiguous else F.lit(None).cast("string"))


def proposed(term: Column, prior: Column, moved: dict[str, str], added: dict[str, str], split: list[tuple[str, Column, str]] = ()) -> Column:
    """A category by precedence: reassigned terms, the reviewer's terms, rules for a prior category, the prior one."""
    lookup = lambda d: reduce(lambda c, kv: c.when(term == kv[0], kv[1]), d.items(), F.when(F.lit(False), "")) if d else F.lit(None)
    rules = [F.when((prior == was) & test, to) for was, test, to in split]
    return F.coalesce(lookup(moved), lookup(added), *rules, prior)


def errors(sheet: DataFrame, categories: list[str], least: int = 10) -> DataFrame:
    """Messages about a worksheet: missing columns (alone), faults of rows, terms approved twice, empty categories."""
    spark = sheet.sparkSession
    if missing := [c for c in WORKSHEET if c not in sheet.columns]:
        return spark.createDataFrame([(f"missing columns: {', '.join(missing)}",)], "error string")
    approved = F.col("status") == "approved"
    faults = all_reasons(
        [
            ("blank term", F.trim(blank(F.col("term"))) == ""),
            ("unknown status", ~F.coalesce(F.col("status").isin("approved", "rejected", "excluded"), F.lit(False))),
            ("unknown category", approved & ~F.coalesce(F.col("proposed_category").isin(categories), F.lit(False))),
            ("blank rationale", F.trim(blank(F.col("rationale"))) == ""),
            ("too rare", approved & (F.coalesce(F.col("review_frequency").cast("int"), F.lit(0)) < least)),
        ]
    )
    rows = sheet.select(F.explode(faults).alias("fault"), "term").select(F.concat(F.col("fault"), F.lit(": "), blank(F.col("term"))).alias("error"))
    twice = sheet.filter(approved).groupBy("term").agg(F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("approved twice: "), "term").alias("error"))
    known = spark.createDataFrame([(c,) for c in categories], "proposed_category string")
    empty = known.join(sheet.filter(approved), "proposed_category", "left_anti").select(F.concat(F.lit("empty category: "), "proposed_category").alias("error"))
    return rows.unionByName(twice).unionByName(empty)


def frozen(sheet: DataFrame, categories: list[str], least: int = 10) -> DataFrame:
    """The approved terms of each category, sorted, as one JSON row; errors (the first 25) stop it."""
    if found := [r["error"] for r in errors(sheet, categories, least).orderBy("error").take(25)]:
        raise ValueError("; ".join(found))
    lists = sheet.filter("status = 'approved'").groupBy("proposed_category").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("proposed_category", F.struct(F.size("terms").alias("term_count"), "terms")))))).alias("dictionary"))


def changed(before: DataFrame, after: DataFrame, key: str, column: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows whose value differs."""
    b, a = before.select(key, F.col(column).alias("before")), after.select(key, F.col(column).alias("after"))
    return b.join(a, key).filter(~F.col("before").eqNullSafe(F.col("after"))).orderBy(key).limit(k)


def value_of(df: DataFrame, column: str, condition: Column):
    """The value of the first row that a condition holds for, or None."""
    row = df.filter(condition).select(column).first()
    return row[0] if row else None
