"""Evaluation of ranked predictions against references, cell by cell (a cell is a model and year, or any other key).

Predictions have cell, id, rank and embedding, references cell, id and embedding. Every metric is computed for all cells
and all k at once; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.models import Encoder, encoded
from quillspark.functions.text import first_words
from quillspark.operators.ranking import at_each_k
from quillspark.operators.similarity import best_at_each_k, best_similarity, dot

BAND = 0.05
TEMPERATURE = 0.1


def best_of_predictions(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """preds with best, the largest cosine with a reference of its cell (null if the cell has none)."""
    best = best_similarity(preds, refs, "cell").select("cell", F.col("key").alias("id"), "best")
    return preds.join(best, ["cell", "id"], "left")


def best_of_references(preds: DataFrame, refs: DataFrame, ks: list[int]) -> DataFrame:
    """(cell, id, k, best) for each reference and k: the largest cosine with one of the first k predictions, or null."""
    best = best_at_each_k(refs, preds, "cell", ks).withColumnRenamed("key", "id")
    every = refs.select("cell", "id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return every.join(best, ["cell", "id", "k"], "left")


def _share(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("double"))


def precision_recall(preds: DataFrame, refs: DataFrame, ks: list[int], threshold: float) -> DataFrame:
    """(cell, k, n_preds, n_gt, coverage, precision, recall, recall_norm, recall_bounded).

    precision is over the predictions that there are, not over k; recall_norm over the smaller of k and the references,
    and may exceed 1; recall_bounded may not. Cells without predictions have none of precision; without references all
    are 0.
    """
    hits = at_each_k(best_of_predictions(preds, refs), ks).groupBy("cell", "k").agg(F.count("*").alias("n_preds"), _share(F.col("best") >= threshold).alias("precision"))
    covered = best_of_references(preds, refs, ks).groupBy("cell", "k").agg(F.count("*").alias("n_gt"), F.count_if(F.col("best") >= threshold).alias("covered"))
    both = hits.join(covered, ["cell", "k"], "full")
    n = F.coalesce("n_gt", F.lit(0))
    norm = F.when(n > 0, F.col("covered") / F.least(F.col("k"), n)).otherwise(0.0)
    return both.select(
        "cell", "k", F.coalesce("n_preds", F.lit(0)).alias("n_preds"), n.alias("n_gt"),
        F.least(F.lit(1.0), F.coalesce("n_preds", F.lit(0)) / F.col("k")).alias("coverage"),
        F.coalesce("precision", F.lit(0.0)).alias("precision"),
        F.when(n > 0, F.col("covered") / n).otherwise(0.0).alias("recall"),
        norm.alias("recall_norm"), F.least(F.lit(1.0), norm).alias("recall_bounded"),
    )


def length_controlled(preds: DataFrame, refs: DataFrame, encoder: Encoder, ks: list[int], threshold: float, words: int = 12) -> DataFrame:
    """precision_recall of predictions (cell, id, rank, text) and references (cell, id, text) that are cut to so many words
    and encoded anew, so that no side gains by its length."""
    cut = lambda df: encoded(df.withColumn("text", first_words(F.col("text"), words)), "text", encoder)
    return precision_recall(cut(preds), cut(refs), ks, threshold)


def uncovered(preds: DataFrame, refs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(cell, id) of the references that none of the first k predictions matches."""
    return best_of_references(preds, refs, [k]).filter(F.coalesce(F.col("best") < threshold, F.lit(True))).select("cell", "id")


def near_threshold(preds: DataFrame, refs: DataFrame, ks: list[int], threshold: float, band: float = BAND) -> DataFrame:
    """How the best cosines lie about the threshold."""
    best = F.col("best")
    return at_each_k(best_of_predictions(preds, refs), ks).groupBy("cell", "k").agg(
        _share(best >= threshold).alias("frac_matched"),
        _share((best >= threshold - band) & (best < threshold)).alias("frac_band"),
        F.avg("best").alias("mean_best"),
        F.percentile("best", F.lit(0.1)).alias("p10_best"),
        F.percentile("best", F.lit(0.5)).alias("p50_best"),
    )


def recycling_rate(preds: DataFrame, corpus: DataFrame, threshold: float) -> DataFrame:
    """(cell, rate): the share of predictions whose best cosine with the cell's corpus reaches the threshold."""
    return best_of_predictions(preds, corpus).groupBy("cell").agg(_share(F.col("best") >= threshold).alias("rate"))


def diversity(preds: DataFrame, k: int) -> DataFrame:
    """(cell, n, pairwise, entropy) of the first k: the mean cosine distance of pairs, from sums alone (the squared
    length of the sum less the sum of squared lengths is twice the sum over pairs), and the entropy of the softmax of
    cosines with the centroid, by the log of n; null for a single one."""
    top = preds.filter(F.col("rank") <= k).select("cell", "id", "embedding")
    dims = top.select("cell", F.posexplode("embedding").alias("d", "x")).groupBy("cell", "d").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = dims.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda p: p.s).alias("total"))  # one value a dimension
    joined = top.join(sums, "cell")
    length = F.sqrt(dot(F.col("total"), F.col("total")))
    n = F.count("*")
    facts = joined.select("cell", dot(F.col("embedding"), F.col("embedding")).alias("own"), dot(F.col("total"), F.col("total")).alias("square"), dot(F.col("embedding"), F.col("total")).alias("with"), length.alias("length"))
    counts = top.groupBy("cell").agg(n.alias("n"))
    logits = facts.join(counts, "cell").withColumn("z", F.col("with") / (F.col("length") + F.col("n") * 1e-9) / TEMPERATURE)
    peak = logits.groupBy("cell").agg(F.max("z").alias("peak"))
    soft = logits.join(peak, "cell").withColumn("e", F.exp(F.col("z") - F.col("peak")))
    agg = soft.groupBy("cell").agg(n.alias("n"), F.first("square").alias("square"), F.sum("own").alias("own"), F.sum("e").alias("se"), F.sum(F.col("e") * (F.col("z") - F.col("peak"))).alias("sez"))
    m = F.col("n").cast("double")
    return agg.select(
        "cell", "n",
        F.when(F.col("n") > 1, 1.0 - (F.col("square") - F.col("own")) / (m * (m - 1))).otherwise(0.0).alias("pairwise"),
        F.when(F.col("n") > 1, (F.log("se") - F.col("sez") / F.col("se")) / F.log(m)).alias("entropy"),
    )


def beyond_retrieval(model: DataFrame, baseline: DataFrame, refs: DataFrame, k: int, threshold: float) -> DataFrame:
    """What a model's first k cover that a baseline's don't: counts of references and the ratios made of them."""
    mask = lambda preds, name: best_of_references(preds, refs, [k]).select("cell", "id", F.coalesce(F.col("best") >= threshold, F.lit(False)).alias(name))
    both = mask(model, "m").join(mask(baseline, "b"), ["cell", "id"])
    m, b = F.col("m"), F.col("b")
    found = both.groupBy("cell").agg(
        F.count("*").alias("n_gt"), F.count_if(m).alias("n_model"), F.count_if(b).alias("n_baseline"),
        F.count_if(m & ~b).alias("n_beyond"), F.count_if(m | b).alias("n_union"),
    )
    ratio = lambda a, c: F.when(c > 0, a / c).otherwise(0.0)
    room = F.col("n_gt") - F.col("n_baseline")
    return found.select(
        "*", ratio(F.col("n_union") - F.col("n_baseline"), F.col("n_gt")).alias("incremental_recall"),
        ratio(F.col("n_beyond"), room).alias("conditional_beyond"), ratio(F.col("n_beyond"), F.col("n_model")).alias("of_model"),
        ratio(F.col("n_beyond"), F.col("n_gt")).alias("frac_gt"),
    )


def composites(precision: Column, context: Column, corpus: Column) -> dict[str, Column]:
    """Extension over what is recycled, and novelty over the mean of both."""
    return {"extension_vs_context": precision - context, "extension_vs_corpus": precision - corpus, "novelty": precision - 0.5 * (context + corpus)}


def long_format(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, value) with a row for each metric; nulls and NaN are left out, infinite values stay."""
    found = df.unpivot(keys, [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
    return found.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def gated(metrics: DataFrame, least: float = 0.5) -> DataFrame:
    """Metrics of cells with too few predictions for k are replaced by one that says so: precision_skipped = 1."""
    low = F.col("coverage") < least
    kept = long_format(metrics.filter(~low), ["cell", "k"], ["coverage", "precision", "recall", "recall_norm"])
    skipped = long_format(metrics.filter(low).withColumn("precision_skipped", F.lit(1.0)), ["cell", "k"], ["coverage", "precision_skipped"])
    return kept.union(skipped)


def report_lines(evaluations: DataFrame) -> DataFrame:
    """(place, line) of a table in Markdown: model, year, metric and k in order; no k is a dash; three decimals."""
    from pyspark.sql import Window

    k = F.when(F.col("k") == 0, "-").otherwise(F.col("k").cast("string"))
    line = F.format_string("| %s | %s | %s | %s | %.3f |", F.col("target_year").cast("string"), F.col("model"), F.col("metric"), k, F.col("value"))
    order = Window.orderBy("model", "target_year", "metric", "k")  # a report has some hundred rows
    return evaluations.select(F.row_number().over(order).alias("place"), line.alias("line"))
