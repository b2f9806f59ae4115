"""Ranks, top-k, first occurrences and seeded samples. Order is always a column, and ties are always broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    """Adds the place of each row in its group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_by_group(df: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """The first k rows of each group; each task drops what can't be among them before rows are shuffled."""
    return ranked(df, by, order, "__rank").filter(F.col("__rank") <= k).drop("__rank")


def top_fraction(df: DataFrame, by: list, order: list, fraction: float, most: int = 0) -> DataFrame:
    """The first ``floor(n * fraction)`` rows of each group, one at least, ``most`` at most if that is positive."""
    n = F.count("*").over(Window.partitionBy(*by))
    use = F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))))
    use = F.least(use, F.lit(most)) if most > 0 else use
    return ranked(df.withColumn("__use", use), by, order, "__rank").filter(F.col("__rank") <= F.col("__use")).drop("__rank", "__use")


def first_occurrences(df: DataFrame, by: list, key: Column, order: list) -> DataFrame:
    """The first row of each key within a group."""
    return top_by_group(df.withColumn("__key", key), [*by, "__key"], order, 1).drop("__key")


def at_each_k(df: DataFrame, ks: list[int], rank: str = "rank") -> DataFrame:
    """The rows of the first k for each k, in one pass, with a column k."""
    return df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col(rank) <= F.col("k"))


def draw_key(seed: int, text: Column) -> Column:
    """A pseudo-random order that any engine can repeat: the md5 of seed and text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))


def uniform(seed: int, text: Column) -> Column:
    """A number in (0, 1) from the same hash."""
    return (F.conv(F.substring(draw_key(seed, text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def sampled(df: DataFrame, n: int, seed: int, text: str, *ties: str) -> DataFrame:
    """n rows without replacement, all rows if there are fewer. A top-k over the hash: only n rows a task are kept. Rows
    of an equal text are taken in the order of the columns ``ties``."""
    return df.withColumn("__draw", draw_key(seed, F.col(text))).orderBy("__draw", text, *ties).limit(n).drop("__draw")


def sampled_by_weight(df: DataFrame, by: list, n: int, seed: int, text: str, weight: Column, *ties: str) -> DataFrame:
    """n rows of each group without replacement, likelier the heavier (by keys ln(u)/w, which is the distribution of
    successive weighted draws). Weights below zero count as zero, and none is quite zero. Rows of an equal key and text are
    taken in the order of the columns ``ties``."""
    w = F.greatest(weight, F.lit(0.0)) + 1e-6
    return top_by_group(df.withColumn("__draw", -F.log(uniform(seed, F.col(text))) / w), by, [F.col("__draw"), F.col(text), *map(F.col, ties)], n).drop("__draw")


def split_off(df: DataFrame, fraction: float, seed: int, text: str) -> DataFrame:
    """Adds ``part``: val for about a fraction of the rows, train for the others; all train if the fraction is none or
    there are fewer than ten rows. A fraction above a half counts as one; the share is rounded to even."""
    n = df.count()
    size = 0 if fraction <= 0 or n < 10 else min(max(1, round(n * min(0.5, fraction))), n // 2)
    if not size:
        return df.withColumn("part", F.lit("train"))
    # The val rows' last key, an order statistic: counts by the hash's first digits tell which rows it is among, and only
    # those few are sorted.
    keys = df.select(draw_key(seed, F.col(text)).alias("__draw"), F.col(text).alias("__text")).withColumn("__head", F.substring("__draw", 1, 4))
    before = 0
    for head, here in sorted(map(tuple, keys.groupBy("__head").count().collect())):  # 65,536 rows at most
        if before + here >= size:
            break
        before += here
    last = keys.filter(F.col("__head") == head).orderBy("__draw", "__text").limit(size - before).agg(F.max(F.struct("__draw", "__text"))).first()[0]
    key = F.struct(draw_key(seed, F.col(text)), F.col(text))
    return df.withColumn("part", F.when(key <= F.struct(F.lit(last[0]), F.lit(last[1])), "val").otherwise("train"))
