"""Audits: what became of generated lines, and how much of predictions was known before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import preview, verbatim_key
from quillspark.operators.evaluate import recycling_rate
from quillspark.operators.filters import audited
from quillspark.sources.tables import settled


def generation_log(lines: DataFrame, by: list[str], text: str, order: str, samples: int = 5) -> DataFrame:
    """(by, log): a JSON record for each group: lines seen and kept, rejections by reason, and the first few rejected. Lines
    are judged once; what both the counts and the samples need of them is a checkpoint."""
    judged = settled(audited(lines, by, text, order).select(*by, order, "reason", F.when(F.col("reason").isNotNull(), preview(F.col("direction"), 80)).alias("shown")))
    counts = judged.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("seen"),
        F.sum(F.when(F.col("reason") == "kept", F.col("n")).otherwise(0)).alias("kept"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason") != "kept", F.struct("reason", "n"))))).alias("rejected"),  # a reason each
    )
    bad = judged.filter("reason is not null").withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("place") <= samples)
    shown = F.struct("place", "reason", F.col("shown").alias("text"))
    some = bad.groupBy(*by).agg(F.sort_array(F.collect_list(shown)).alias("samples"))
    return totals.join(some, by, "left").select(*by, F.to_json(F.struct("seen", "kept", "rejected", "samples")).alias("log"))


def log_lines(lines: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """(by, order, line): RAW, REJECT with its reason, KEPT, or EMPTY where a group has nothing kept. Lines are judged once;
    what is told of them is a checkpoint, as both the lines and the groups are made of it."""
    raw = lines.withColumn("__raw", F.concat(F.lit("RAW "), preview(F.col(text))))
    kept = F.col("reason").isNull()
    verdict = F.when(kept, F.concat(F.lit("KEPT "), "direction")).otherwise(F.concat(F.lit("REJECT "), "reason", F.lit(" "), preview(F.col("direction"))))
    judged = settled(audited(raw, by, text, order).select(*by, order, "__raw", verdict.alias("__verdict"), kept.alias("__kept")))
    told = judged.select(*by, order, F.explode(F.array("__raw", "__verdict")).alias("line"))
    empty = judged.groupBy(*by).agg(F.count_if("__kept").alias("n")).filter("n = 0").select(*by, F.lit(None).cast(judged.schema[order].dataType).alias(order), F.lit("EMPTY").alias("line"))
    return told.unionByName(empty)


def verbatim_rate(preds: DataFrame, by: list[str], text: str, corpus: DataFrame, corpus_text: str) -> DataFrame:
    """(by, rate): the share of predictions that stand in the corpus but for case and white space."""
    known = corpus.select(verbatim_key(F.col(corpus_text)).alias("__k")).distinct().withColumn("__hit", F.lit(1.0))
    joined = preds.withColumn("__k", verbatim_key(F.col(text))).join(known, "__k", "left")
    return joined.groupBy(*by).agg(F.avg(F.coalesce("__hit", F.lit(0.0))).alias("rate"))


def contamination(preds: DataFrame, context: DataFrame, corpus: DataFrame, train: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """(cell, corpus_recycling, context_recycling, train_eval_overlap): shares of predictions that a corpus or the context
    has already, and of true questions that training texts have. All tables have cell, id and embedding."""
    parts = {"corpus_recycling": (preds, corpus), "context_recycling": (preds, context), "train_eval_overlap": (truth, train)}
    out = None
    for name, (left, right) in parts.items():
        rate = recycling_rate(left, right, threshold).withColumnRenamed("rate", name)
        out = rate if out is None else out.join(rate, "cell", "full")
    return out
