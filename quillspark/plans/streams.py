"""Streaming queries, run over what there is and read back; SQL gives the same in one batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quillspark.streaming import ingest


def shared_folder(spark) -> str:
    """A folder that the driver and the executors share; a temporary one only where none is named, as in tests."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return f"{found}/stream-{uuid.uuid4().hex}"
    return f"file://{tempfile.mkdtemp(prefix='stream-')}/{uuid.uuid4().hex}"


def stream_window_counts(spark, sf_dir):
    """Events and values by day and type. The last windows are closed by the table's own end, so the state is kept in
    full and the latest of each window is read."""
    at = shared_folder(spark)
    counts = ingest.window_counts(ingest.event_stream(spark, sf_dir), "1 day", "36500 days")
    ingest.run_latest(counts, f"{at}/counts", f"{at}/checkpoint", ["start", "event_type"], [F.desc("n")])
    found = ingest.latest(spark, f"{at}/counts")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


def stream_first_arrivals(spark, sf_dir):
    """Each user's first event as it arrives, written to a table."""
    at = shared_folder(spark)
    arrivals = ingest.first_arrivals(ingest.event_stream(spark, sf_dir), ["event_id"], "36500 days")
    ingest.run_to_table(arrivals.select("event_id", "user_id"), f"{at}/rows", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/rows").groupBy("user_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_window_counts, stream_first_arrivals)}
ORACLE = {
    "stream_window_counts": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) n, round(sum(value), 4) as value from events group by all",
    "stream_first_arrivals": "select user_id, count(distinct event_id) n from events group by user_id",
}
