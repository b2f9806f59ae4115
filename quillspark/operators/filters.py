"""Filters on lists of directions, with the reasons, and format statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import directions as D
from quillspark.functions import patterns as P
from quillspark.functions.text import has, n_words, stripped


def audited(df: DataFrame, by: list[str], text: str, order: str, **limits) -> DataFrame:
    """Adds direction (the bare text) and reason: why a row is rejected, ``duplicate`` if an earlier valid row of its
    group has the same text in lower case, or null."""
    # What a generator makes is computed once, however often its fields are used.
    made = df.select("*", F.inline(F.array(F.struct(D.bare(F.col(text)).alias("direction")))))
    judged = made.select("*", F.inline(F.array(F.struct(D.bare_rejection(F.col("direction"), **limits).alias("reason")))))
    earlier = F.row_number().over(Window.partitionBy(*by, F.lower("direction"), F.col("reason").isNull()).orderBy(order)) > 1
    return judged.withColumn("__again", earlier).withColumn("reason", F.when(F.col("reason").isNull() & F.col("__again"), "duplicate").otherwise(F.col("reason"))).drop("__again")


def kept_directions(df: DataFrame, by: list[str], text: str, order: str, **limits) -> DataFrame:
    return audited(df, by, text, order, **limits).filter("reason is null").drop("reason")


def compliance(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Shares of the rows of each group that keep to the format in each respect, in one aggregation."""
    t, reason = F.col(text), F.col("__reason")
    n = n_words(D.bare(t))
    share = lambda test: F.avg(test.cast("double"))
    return df.withColumn("__reason", D.rejection(t)).groupBy(*by).agg(
        F.count("*").alias("n"),
        share(has(stripped(t), r"^\d+[.)]\s+\S")).alias("frac_numbered"),
        share(reason.isNull()).alias("frac_valid"),
        share(D.is_noise(reason)).alias("frac_noise"),
        share(t.contains("?")).alias("frac_question_mark"),
        share(has(t, P.DOI) | has(t, P.IDS)).alias("frac_doi"),
        share(has(stripped(t), P.YEAR_PREFIX)).alias("frac_year_prefix"),
        share(n.between(8, 25)).alias("frac_words_ok"),
        F.avg(n.cast("double")).alias("mean_words"),
    )
