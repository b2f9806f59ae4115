"""Pools of questions that fall back to wider ones: ground truth and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.directions import is_clean_truth
from quillspark.functions.text import stripped
from quillspark.operators.ranking import top_by_group

YEARS_BACK = 5


def _worded(questions: DataFrame) -> DataFrame:
    return questions.filter(F.length(stripped(F.coalesce("question_text", F.lit("")))) > 0)


def tiered(questions: DataFrame, critical: bool = True, clean: bool = True) -> DataFrame:
    """The ground truth of each year, with the tier that it came from: critical and clean questions (1), or if a year
    has none the clean ones (2), or else all that have a text (3). One aggregation over years, whose few rows are joined
    back."""
    found = _worded(questions)
    good = is_clean_truth(F.col("question_text")) if clean else F.lit(True)
    wanted = (F.col("is_critical") == 1) if critical else F.lit(True)
    found = found.withColumn("__own", F.when(wanted & good, 1).when(good, 2).otherwise(3))
    best = found.groupBy("year").agg(F.min("__own").alias("tier"))
    return found.join(best, "year").filter(F.col("__own") <= F.col("tier")).drop("__own")


def context_window(questions: DataFrame, year: int, most: int) -> DataFrame:
    """The best ``most`` questions of a year and the five before it, by impact, then year, text and id; if there is
    none, the first of any year up to it by the same order. Both are decided in one top-k."""
    found = questions.filter(F.col("year") <= year)
    inside = F.col("year") >= max(year - YEARS_BACK, 0)
    order = [F.desc(inside), F.desc(F.coalesce("impact_score", F.lit(0.0))), F.desc("year"), F.col("question_text"), F.col("id")]
    first = found.withColumn("__in", inside).orderBy(*order).limit(most)
    some = F.max("__in").over(Window.partitionBy())
    return first.withColumn("__some", some).filter(~F.col("__some") | F.col("__in")).drop("__in", "__some")


def truth_per_year(questions: DataFrame, most: int) -> DataFrame:
    """At most so many ground-truth rows of each year, the best first."""
    return top_by_group(tiered(questions), ["year"], [F.desc("impact_score"), F.col("question_text"), F.col("id")], most)
