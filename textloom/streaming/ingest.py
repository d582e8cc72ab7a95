"""Resumable ingest: new pages or records in, each once, appended by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textloom.functions.text import content_key


def files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", most: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).format(kind).load(path)


def once(stream: DataFrame, text: str, key: str = "record", time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each text once by its hash. With an event time the state is bounded by the delay; without, it grows."""
    keyed = stream.withColumn(key, content_key(F.col(text)))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else keyed.dropDuplicates([key])


def append_months(stream: DataFrame, day: str, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and stops; the checkpoint makes the next run go on from it."""
    months = stream.withColumn("ym", F.date_format(F.col(day), "yyyy_MM"))
    return months.writeStream.partitionBy("ym").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def windowed(stream: DataFrame, time: str, size: str, by: list[str], value: str, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window, late rows up to the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def ledger(path: str, schema: StructType, text: str, key: str = "record"):
    """A batch handler that adds each text once to the table at ``path``, whatever is killed and run again.

    A batch is written as its own partition, whole or not at all, and a batch that runs again replaces what it wrote; it
    looks for earlier copies only in the batches before its own. The table is its own record of what was seen: no state
    is kept beside it. Of equal texts within a batch the first by its columns stays."""
    kept = StructType([*schema.fields, StructField(key, StringType()), StructField("batch", LongType())])

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn(key, content_key(F.col(text)))
        # A batch that runs again must choose the same rows.
        first = keyed.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in batch.columns])).alias("tl_row")).select(key, "tl_row.*")
        if number:
            first = first.join(spark.read.schema(kept).parquet(path).filter(F.col("batch") < number).select(key), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def add_once(stream: DataFrame, text: str, path: str, checkpoint: str, key: str = "record", handler=None) -> StreamingQuery:
    """Runs over what is there and stops; the next run goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(handler or ledger(path, stream.schema, text, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
