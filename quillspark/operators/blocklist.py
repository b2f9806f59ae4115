"""Copies of blocked texts: equal keys, and long keys that start alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.directions import direction_key

PREFIX, LONG = 80, 40


def copies(df: DataFrame, text: str, blocked: DataFrame, blocked_text: str) -> DataFrame:
    """The rows of df whose key equals a blocked one, or begins as one does.

    Keys of LONG characters and more begin alike if their first PREFIX characters are equal, or if one that is shorter
    than that is the other's start. Shorter keys are themselves their first PREFIX characters, so no more of a key goes
    anywhere. Rows meet the blocked keys by their first LONG characters, once each; those that share these with any are
    then looked up, by the starts of the lengths that blocked keys with that beginning have, and whole among the starts of
    blocked keys. Of blocked keys those stay that no other begins: a row has one of them for its start at most, or is
    shorter than all, so it is found once at most, however many keys begin alike.
    """
    begun = lambda c: F.substring(c, 1, LONG)
    keys = blocked.select(F.substring(direction_key(F.col(blocked_text)), 1, PREFIX).alias("__b")).filter("__b <> ''").distinct()
    # The lengths of the keys with a beginning: PREFIX - LONG + 1 at most.
    lengths = keys.groupBy(begun(F.col("__b")).alias("__start")).agg(F.collect_set(F.length("__b")).alias("__lengths"))
    start_of = lambda c, most: F.transform(F.filter("__lengths", lambda n: n <= most), lambda n: F.substring(c, F.lit(1), n))
    longer = keys.withColumn("__start", begun(F.col("__b"))).join(lengths.filter(F.size("__lengths") > 1), "__start")
    begins = longer.select("__b", F.explode(start_of(F.col("__b"), F.length("__b") - 1)).alias("__look"))
    begin = begins.join(keys.select(F.col("__b").alias("__look")), "__look", "left_semi").select("__b").distinct()
    least = keys.join(begin, "__b", "left_anti")
    starts = least.filter(F.length("__b") > LONG).select(
        F.explode(F.transform(F.sequence(F.lit(LONG), F.length("__b") - 1), lambda n: F.concat(F.lit("<"), F.substring("__b", F.lit(1), n)))).alias("__look")
    )
    lookups = least.select(F.concat(F.lit("="), "__b").alias("__look")).union(starts)
    # A row made by a generator is computed once, however often its fields are used and filtered by.
    made = F.inline(F.array(F.struct(F.substring(direction_key(F.col(text)), 1, PREFIX).alias("__k"))))
    keyed = df.select("*", made).filter("__k <> ''").withColumn("__start", begun(F.col("__k")))
    own, n = F.col("__k"), F.length("__k")
    inside = F.when((n >= LONG) & (n < PREFIX), F.array(F.concat(F.lit("<"), own))).otherwise(F.array().cast("array<string>"))
    tried = F.concat(F.transform(start_of(own, n), lambda s: F.concat(F.lit("="), s)), inside)
    near = keyed.join(lengths, "__start").select(*df.columns, F.explode(tried).alias("__look"))
    return near.join(lookups, "__look", "left_semi").select(*df.columns)
