"""What several operators share: the shared folder, written intermediate tables, word patterns, null-safe texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as Java and RE2 character class members.
SPACES = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one of spark.checkpoint.dir, or else the one the context already has. Only where neither is set, as in
    local tests, a temporary folder is made and set.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if (known := context._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quillspark-')}")
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table that is written meanwhile is deleted as soon as the table is complete, rather than when
    the driver happens to collect garbage. The session's setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Intermediate tables that aren't deleted yet, by application.
_LEFT: dict[str, list[str]] = {}


def clear_intermediates(spark: SparkSession) -> None:
    """Deletes all intermediate tables that operators have written for results so far. Call it once the results are
    consumed: a result is read from them until then."""
    removed(spark, *_LEFT.pop(spark.sparkContext.applicationId, []))


def written(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it back: this cuts its lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.options(**options).parquet(path)
    _LEFT.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables through the store's own interface."""
    jvm = spark.sparkContext._jvm
    left = _LEFT.get(spark.sparkContext.applicationId, [])
    left[:] = [path for path in left if path not in set(paths)]
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def driver_tidied(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage, and give memory back to the system, before much is sent to it: what earlier
    results and broadcasts took would count beside that."""
    spark.sparkContext._jvm.System.gc()


#: Rows of numbers for each file of an intermediate table.
ROWS = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in a partition for each ROWS of its rows, if it has more partitions: small tables make few small files."""
    return df.coalesce(max(1, ceil(rows / ROWS)))


class Scratch:
    """Intermediate tables that are deleted once what they lead to is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """The table, written by a task for each ROWS of about so many rows, if that is known to be less than it has."""
        table, path = written(df if rows is None else gathered(df, rows), name)
        self.paths.append(path)
        return table

    def clear(self) -> None:
        removed(self.spark, *self.paths)
        self.paths.clear()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> Iterator[None]:
    """While a table is written, Python workers get batches of at most so many rows and bytes: whole texts in the default
    ten thousand rows, or 64 MB, take much memory on both sides. The session's settings are put back."""
    name, bytes_name = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, bytes_before = spark.conf.get(name), spark.conf.get(bytes_name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    spark.conf.set(bytes_name, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)
        spark.conf.set(bytes_name, bytes_before)


def partitions(df: DataFrame) -> int:
    """As many as the session's shuffles have, or as df is read in, if that is more: larger inputs get more tasks, not
    larger ones."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """How many runs of other than ASCII white space a text has; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    spaces = F.lit(" \t\n\x0b\x0c\r")
    edge = lambda c: (F.instr(spaces, c) > 0).cast("long")
    parts = F.size(F.split(text, f"[{SPACES}]+")).cast("long")
    return F.when(text == "", F.lit(0).cast("long")).otherwise(
        parts - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))
    )
