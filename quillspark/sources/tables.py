"""Readers of the driver's Parquet tables and their mapping to the literature schemas."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns and filters push down to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a scan has fewer partitions than those, as an unsplit file has. Larger inputs stay
    as they are read, so what is shuffled is little."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder of spark.checkpoint.dir, which survives lost executors. Only
    where that is unset, as in local tests, a temporary folder is made."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='quillspark-')}")
    return df.checkpoint()


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles(pmid, year, title, abstract); the year is derived from the id."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        F.col("doc_id").cast("string").alias("pmid"),
        (2000 + F.col("doc_id") % 27).cast("int").alias("year"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as citation counts; parts divisible by 3 stay uncited."""
    items = table(spark, sf_dir, "lineitem")
    return (
        items.filter(F.col("l_partkey") % 3 != 0)
        .groupBy(F.col("l_partkey").cast("string").alias("pmid"))
        .agg(F.count("*").alias("citation_count"))
    )
