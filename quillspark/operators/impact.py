"""Citation impact: age-normalised rates and per-year order-statistic labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def years_since(year: Column, ref_year: int) -> Column:
    """Age in years, at least one."""
    return F.greatest(F.lit(1), F.lit(ref_year) - year)


def citation_rate(count: Column, year: Column, ref_year: int) -> Column:
    """Citations a year since publication; a missing count is zero."""
    return F.coalesce(count, F.lit(0)).cast("double") / years_since(year, ref_year).cast("double")


def label_critical(df: DataFrame, rate: str = "rate", year: str = "year", key: str = "pmid", p: float = 0.9) -> DataFrame:
    """Adds ``is_critical``: 1 for rows whose positive rate reaches the order statistic of their year.

    The threshold is the value at index ``max(0, int(n*p) - 1)`` of a year's rates in ascending order; all ties at
    it qualify. Counts of equal rates are summed before the window, so a year costs as many rows as it has
    distinct rates. Rows without a year belong to no label and are dropped; an empty input stays empty.
    """
    known = df.filter(F.col(year).isNotNull())
    rates = known.groupBy(year, rate).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(year).orderBy(F.col(rate).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    place = F.greatest(F.floor(F.lit(p) * F.sum("__n").over(Window.partitionBy(year))) - 1, F.lit(0)) + 1
    thresholds = (
        rates.withColumn("__upto", F.sum("__n").over(upto))
        .withColumn("__place", place)
        .filter((F.col("__upto") >= F.col("__place")) & (F.col("__upto") - F.col("__n") < F.col("__place")))
        .select(F.col(year).alias("__year"), F.col(rate).alias("__threshold"))
    )
    critical = (F.col(rate) >= F.col("__threshold")) & (F.col(rate) > 0)
    return (
        known.join(thresholds, F.col(year) == F.col("__year"))
        .withColumn("is_critical", F.when(critical, 1).otherwise(0))
        .drop("__year", "__threshold")
    )
