"""Streams over files that arrive one by one."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.operators.store import Store
from quillspark.streaming import ingest


def write(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/{name}")


def test_counts_go_on_from_the_checkpoint(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=7 * k), k % 3, "click", 1.0, "{}") for k in range(40)]
    at = f"file://{tmp_path}"
    for part, some in enumerate((rows[:20], rows[20:])):
        write(spark, f"{at}/in", f"p{part}", some)
        stream = spark.readStream.schema(ingest.EVENTS).option("recursiveFileLookup", "true").parquet(f"{at}/in").withColumn("ts", F.col("ts").cast("timestamp"))
        ingest.run_latest(ingest.window_counts(stream, "1 hour", "1 day"), f"{at}/out", f"{at}/check", ["start", "event_type"], [F.desc("n")])
    found = ingest.latest(spark, f"{at}/out")
    assert found.agg(F.sum("n")).first()[0] == 40 and found.count() == 5


def test_repeats_are_dropped_and_batches_upserted(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = [(k % 5, datetime(2024, 1, 1), 1, "view", float(k), "{}") for k in range(10)]
    write(spark, f"{at}/in", "p", rows)
    stream = spark.readStream.schema(ingest.EVENTS).option("recursiveFileLookup", "true").parquet(f"{at}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals = ingest.first_arrivals(stream, ["event_id"])
    store = Store(spark, f"{at}/store")
    cites = arrivals.select(F.col("event_id").cast("string").alias("pmid"), F.lit(3).cast("long").alias("citation_count"))
    ingest.run_upserts(cites, store, "citations", ["pmid"], [F.desc("citation_count")], f"{at}/check")
    assert sorted(r.pmid for r in store.read("citations").collect()) == list("01234")
