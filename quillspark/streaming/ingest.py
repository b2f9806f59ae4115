"""Streams: event-time windows, ingest without repeats, upserts by micro-batch.

Everything is Structured Streaming over file sources; a run takes what there is and stops, and its checkpoint makes the
next one go on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.models import Generator
from quillspark.operators.generate import extracted
from quillspark.operators.store import Store, merge_upsert
from quillspark.sources.tables import settled

EVENTS = T.StructType().add("event_id", "long").add("ts", "timestamp_ntz").add("user_id", "long").add("event_type", "string").add("value", "double").add("props", "string")
DELAY = "10 minutes"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 8) -> DataFrame:
    """The events of a folder's files as a stream, with ts as an instant in UTC."""
    found = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, folder: str, name: str, schema: str, files: int = 8) -> DataFrame:
    """A table of a data directory, a file or a folder of files, as a stream."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    inside = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}.parquet").load(folder).select("path").limit(1).count()
    return found.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if inside else found.parquet(f"{folder}/{name}.parquet")


def run_directions(articles: DataFrame, store: Store, generator: Generator, checkpoint: str, style: str = "topic") -> None:
    """Draws directions from articles (pmid, title, abstract) as they arrive and upserts them; articles that have one are
    left alone, so a batch that is repeated, or an article that comes again, costs nothing."""

    def draw(batch: DataFrame, _: int) -> None:
        todo = batch.dropDuplicates(["pmid"]).join(store.read("article_segments").select("pmid"), "pmid", "left_anti")
        store.upsert("article_segments", settled(extracted(todo, generator, style)), ["pmid"], [F.col("question")])

    articles.writeStream.foreachBatch(draw).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(events: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Events and values by window and type; a window is final once the watermark has passed it."""
    seen = events.withWatermark("ts", delay)
    counted = seen.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def first_arrivals(rows: DataFrame, key: list[str], delay: str = DELAY) -> DataFrame:
    """Rows without repeats of a key within the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def run_upserts(stream: DataFrame, store: Store, name: str, key: list[str], order: list[Column], checkpoint: str) -> None:
    """Upserts each micro-batch into a table; a batch that is repeated after a failure changes nothing more."""

    def merge(batch: DataFrame, _: int) -> None:
        store.upsert(name, batch, key, order)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the tables that run_latest has written, in order."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(place)) if fs.exists(place) else []


def run_latest(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[Column]) -> None:
    """Keeps the latest state of an aggregation: the rows that a batch changes replace those of the same key in the
    table of the batch before, and the result is the table of this batch. A batch that is repeated, also in a later run,
    starts from the same table and gives the same."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = [n for n in versions(spark, path) if n < number]
        whole = merge_upsert(spark.read.parquet(f"{path}/{before[-1]}"), batch, key, order) if before else batch
        whole.write.mode("overwrite").parquet(f"{path}/{number}")

    stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{versions(spark, path)[-1]}")
