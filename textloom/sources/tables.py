"""Sources and sinks: tables, CSV, JSON lines, dictionaries, partitioned appends, atomic rewrites, manifests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def struct(**kinds) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


#: Record and index schemas.
RECORD = struct(title=StringType(), text=StringType(), score=IntegerType(), day=StringType(), link=StringType(), record=StringType())
INDEX = struct(entry=StringType(), link=StringType(), name=StringType(), score=IntegerType(), day=StringType(), snippet=StringType(), page_kind=StringType())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: the cluster's checkpoint folder, or one of our own where none is set and all
    runs on one machine; a cluster without one is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        path = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage for iterations. What was shuffled for it
    goes as soon as it is written, not when the driver happens to collect its garbage."""
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    at, was = f"{shared_folder(spark)}/textloom/settled-{uuid.uuid4().hex}", spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(clean, was)
    return spark.read.schema(df.schema).parquet(at)


def let_go(df: DataFrame) -> None:
    """Deletes what ``settled`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if "/textloom/settled-" in folder:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def csv(spark: SparkSession, path: str, schema: StructType | None = None, blank_is_value: bool = False) -> DataFrame:
    """A CSV file or a folder or glob of them, with quoted line breaks; blanks can stay empty texts."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if blank_is_value:
        reader = reader.option("nullValue", "\0").option("emptyValue", "")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", not blank_is_value).csv(path)
    return df.fillna("") if blank_is_value else df


def csv_in_order(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of many files with the file and the place in it, for operators that depend on order."""
    return csv(spark, path, schema).select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"))


def json_lines(spark: SparkSession, path: str, field: str = "url") -> DataFrame:
    """One value a line: a JSON object's field, or the line itself."""
    line = F.trim("value")
    value = F.when(F.startswith(line, F.lit("{")), F.get_json_object(line, f"$.{field}")).otherwise(line)
    return spark.read.text(path).select(value.alias(field)).filter(F.coalesce(F.col(field), F.lit("")) != "")


def dictionaries(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(document, category, short_name, term, error) of any number of dictionary documents, each a file or, unless
    ``whole``, a line; they are taken apart as variants where they are read, and none passes through the driver.

    ``document`` is the hash of its text. What can't be used is a row with an error: a text that is no JSON object, a
    document that isn't frozen, a category without a short name. Terms that are no texts are left out."""
    read = spark.read.text(path, wholetext=whole).filter(F.trim("value") != "").select(F.sha2("value", 256).alias("document"), F.try_parse_json("value").alias("v"))
    state = F.when(F.col("v").isNull() | (F.try_variant_get("v", "$.categories", "variant").isNull() & F.try_variant_get("v", "$.status", "string").isNull()), "no dictionary")
    judged = read.withColumn("error", state.when(~F.try_variant_get("v", "$.status", "string").eqNullSafe(F.lit("frozen")), "not frozen"))
    good = spark.sql(
        """SELECT d.document, c.key AS category, try_variant_get(c.value, '$.short_name', 'string') AS short_name, try_variant_get(c.value, '$.terms', 'variant') AS terms
        FROM {judged} d, LATERAL variant_explode(try_variant_get(d.v, '$.categories', 'variant')) c WHERE d.error IS NULL""",
        judged=judged,
    )
    found = spark.sql("SELECT g.document, g.category, g.short_name, try_variant_get(t.value, '$', 'string') AS term FROM {good} g, LATERAL variant_explode(g.terms) t WHERE g.short_name <> ''", good=good)
    none = F.lit(None).cast("string")
    bad = judged.filter("error IS NOT NULL").select("document", none.alias("category"), none.alias("short_name"), none.alias("term"), "error")
    unnamed = good.filter("coalesce(short_name, '') = ''").select("document", "category", none.alias("short_name"), none.alias("term"), F.lit("no short name").alias("error"))
    return found.filter("term IS NOT NULL").withColumn("error", none).unionByName(bad).unionByName(unnamed)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(category, short_name, term) of a frozen dictionary document; one that isn't frozen is an error."""
    found = dictionaries(spark, path)
    wrong = found.filter("error IS NOT NULL").select("error").first()
    if wrong:
        raise ValueError("the dictionary is not frozen" if wrong["error"] == "not frozen" else f"the dictionary is not usable: {wrong['error']}")
    return found.select("category", "short_name", "term")


def names_by_length(df: DataFrame, column: str, condition: Column | None = None) -> DataFrame:
    """Distinct names, the longest first."""
    kept = df.filter(condition) if condition is not None else df
    return kept.select(F.col(column)).distinct().orderBy(F.length(column).desc(), column)


def candidate_links(spark: SparkSession, pattern: str, years: tuple[int, int], months: list[str], parts: int) -> DataFrame:
    """Links of all years, months and parts, from a pattern of month, two-digit year and part."""
    grid = spark.range(years[0], years[1] + 1).select(F.col("id").alias("year")).withColumn("month", F.explode(F.array(*map(F.lit, months)))).withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    return grid.select("year", "month", "part", F.format_string(pattern, "month", F.lpad((F.col("year") % 100).cast("string"), 2, "0"), "part").alias("url"))


def unseen(df: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key an earlier run has not handled, each key once."""
    return df.dropDuplicates(key).join(seen.select(*key), key, "left_anti")


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """Fixed fields in their order. An existing target is an error unless the mode says otherwise."""
    df.select(*fields).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_by_month(df: DataFrame, path: str, day: str) -> None:
    df.withColumn("ym", F.date_format(F.col(day), "yyyy_MM")).write.mode("append").partitionBy("ym").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Rewrites the partitions that ``df`` has, each as a whole, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Adds to a log of JSON lines."""
    df.write.mode("append").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Rewrites a whole table: readers see the old one until the new one is complete, which may be made from the old."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    of = spark._jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    if files.exists(of(path)):
        files.rename(of(path), of(old))
    if not files.rename(of(fresh), of(path)):
        files.rename(of(old), of(path))
        raise OSError(f"{path} could not be replaced")
    files.delete(of(old), True)


def cached(links: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with the content that a cache (key, content; the key is the link's SHA-256) holds, and the links, each once,
    that it lacks."""
    keyed = links.withColumn("key", F.sha2("url", 256))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def manifest(df: DataFrame) -> DataFrame:
    """One row with a JSON object of a one-row frame."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("manifest"))


def file_counts(df: DataFrame) -> DataFrame:
    """Rows by source file, counted as records, not lines."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
