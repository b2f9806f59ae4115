"""Whole runs over a store: collecting, directions, an index, predictions and their evaluation. Each goes on from what is
stored, and logs itself."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.directions import resolved_subject, weighted_impact
from quillspark.functions.models import CompletionScorer, Encoder, Generator, HashingEncoder, PromptScorer, encoded
from quillspark.operators import evaluate as E
from quillspark.operators.filters import compliance
from quillspark.operators.forecast import context_rows, contexts, frequency_forecast, random_forecast
from quillspark.operators.generate import extracted, listed
from quillspark.operators.impact import citation_rate, label_critical
from quillspark.operators.pools import tiered
from quillspark.operators.retrieval import bm25_scores, tfidf_embedded, top_texts
from quillspark.operators.similarity import centroid, scored_against
from quillspark.operators.store import Store, run_id
from quillspark.sources.collect import Collect, citation_counts, fetched, found_ids, skipped, uncited, worklist
from quillspark.sources.export import parsed
from quillspark.sources.tables import settled, spread


def index_counts(store: Store) -> dict[str, int]:
    """How far an index is."""
    articles = store.read("articles")
    return {
        "articles": articles.count(),
        "cited": articles.join(store.read("citations").select("pmid"), "pmid", "left_semi").count(),
        "segmented": articles.join(store.read("article_segments").select("pmid"), "pmid", "left_semi").count(),
        "questions": (questions := store.read("questions")).count(),
        "embedded": questions.filter("embedding is not null").count(),
    }


def is_ready(counts: dict[str, int]) -> bool:
    return counts["questions"] > 0 and counts["embedded"] == counts["questions"]


def collect_run(store: Store, what: Collect, client: str, now: datetime, most: int | None = None, wait: float = 1.0) -> DataFrame:
    """Finds, fetches, parses and stores the articles of a search that aren't stored yet; returns the ids that gave none."""
    todo = settled(worklist(found_ids(store.spark, what, client, wait), store.read("articles"), most))
    found = settled(parsed(fetched(spread(todo), client, wait), what.year_to + 1))
    store.upsert_articles(found.drop("raw_block"), now)
    store.log_run(run_id("collect", now), "collect", now)
    return skipped(todo, found)


def citation_run(store: Store, client: str, now: datetime, wait: float = 1.0) -> int:
    """Looks up the citations of articles that have none stored; how many there were."""
    counts = settled(citation_counts(spread(uncited(store.read("articles"), store.read("citations"))), client, wait))
    store.upsert("citations", counts.withColumn("fetched_at", F.lit(now)), ["pmid"], [F.desc("fetched_at")])
    return counts.count()


def direction_run(store: Store, generator: Generator, now: datetime, style: str = "topic", force: bool = False) -> int:
    """Draws a direction from each article that has no segment yet, or from all; how many articles were read."""
    articles = store.read("articles")
    todo = articles if force else articles.join(store.read("article_segments").select("pmid"), "pmid", "left_anti")
    found = settled(extracted(spread(todo), generator, style).withColumn("updated_at", F.lit(now)))
    store.upsert("article_segments", found, ["pmid"], [F.desc("updated_at")])
    store.log_run(run_id("direction", now), "direction", now)
    return found.count()


def impact_table(articles: DataFrame, citations: DataFrame, ref_year: int, year_min: int = 2000, year_max: int = 2027, p: float = 0.9) -> DataFrame:
    """(pmid, year, abstract, rate, is_critical) of every article of these years: citations a year, and the mark of its
    year's highest."""
    dated = articles.filter(F.coalesce(F.col("year").between(year_min, year_max), F.lit(False)))
    rated = dated.join(citations.select("pmid", "citation_count"), "pmid", "left").withColumn("rate", citation_rate(F.col("citation_count"), F.col("year"), ref_year))
    return label_critical(rated.select("pmid", "year", "abstract", "rate"), p=p)


def build_questions(store: Store, marked: DataFrame) -> DataFrame:
    """Questions of the segments' subjects, with the impact of their articles weighted by score."""
    joined = store.read("article_segments").join(marked, "pmid")
    subject = resolved_subject(F.col("question"), F.col("abstract"), F.col("qc_score"), F.col("segmentation_method"))
    found = joined.select("pmid", "year", "rate", "is_critical", F.inline(F.array(subject))).filter("text is not null")
    return found.select(F.xxhash64("pmid").alias("id"), "pmid", F.col("text").alias("question_text"), "year", weighted_impact(F.col("rate"), F.col("score")).alias("impact_score"), "is_critical")


def embed_missing(store: Store, encoder: Encoder | None, now: datetime) -> int:
    """Encodes the questions that have no vector, by TF-IDF where there is no encoder; how many there were."""
    missing = store.read("questions").filter("embedding is null")
    found = encoded(missing, "question_text", encoder) if encoder else tfidf_embedded(missing.drop("embedding"), "id", "question_text")
    found = settled(found)
    store.upsert("questions", found, ["id"], [F.col("pmid")])
    store.log_run(run_id("embed", now), "embed", now)
    return found.count()


def run_index(store: Store, encoder: Encoder, ref_year: int, now: datetime, force: bool = False) -> dict[str, int]:
    """Impact, questions and vectors from what is collected; nothing if the index is ready. Vectors of questions whose text
    is as it was are kept. An index that has no question afterwards is an error."""
    if not force and is_ready(counts := index_counts(store)):
        return counts
    marked = settled(impact_table(store.read("articles"), store.read("citations"), ref_year))
    store.write("article_impact", marked.withColumnRenamed("rate", "impact_score"))
    known = store.read("questions").select("id", "question_text", "embedding")
    store.write("questions", build_questions(store, marked).join(known, ["id", "question_text"], "left"))
    store.log_run(run_id("index", now), "index", now)
    embed_missing(store, encoder, now)
    if not is_ready(counts := index_counts(store)):
        raise RuntimeError("the index has no questions with vectors")
    return counts


def predict_run(
    store: Store, models: list[str], years: list[int], k: int, now: datetime, generators: dict[str, Generator] | None = None,
    scorer: CompletionScorer | None = None, encoder: Encoder | None = None, context: int = 30, each: int = 1, seed: int = 42,
) -> str:
    """Stores the k predictions of each model for each year and returns the run's id. A model is frequency, random, or one
    of the generators, which continue the context of the year before; an unknown model is an error."""
    questions, run = store.read("questions"), run_id("predict", now)
    asked = store.spark.createDataFrame([(y,) for y in years], "year int")
    parts = []
    for model in models:
        if model == "frequency":
            parts.append(frequency_forecast(questions, asked, k).withColumn("model", F.lit(model)))
        elif model == "random":
            parts.append(random_forecast(questions, asked, k, seed).withColumn("model", F.lit(model)))
        elif model in (generators or {}):
            before = contexts(questions, asked.select((F.col("year") - 1).alias("year")), context)
            cells = before.select(F.lit(model).alias("model"), F.col("year").alias("context_year"), (F.col("year") + 1).cast("int").alias("target_year"), "context")
            parts.append(listed(settled(cells), generators[model], scorer or PromptScorer(), encoder or HashingEncoder(), k, each=each, seed=seed))
        else:
            raise ValueError(f"no model {model!r}")
    rows = parts[0].select("model", "target_year", "rank", "text", "score")
    for part in parts[1:]:
        rows = rows.unionByName(part.select("model", "target_year", "rank", "text", "score"))
    ranked = rows.select(
        F.xxhash64("model", "target_year", "rank", F.lit(run)).alias("id"), "target_year", "model", "rank", F.col("text").alias("question_predicted"), "score",
        F.lit(run).alias("run_id"), F.lit(now).alias("created_at"),
    )
    store.replace_predictions(settled(ranked))
    store.log_run(run, "predict", now)
    return run


def baselines(questions: DataFrame, years: list[int], k: int, context: int = 30) -> dict[str, DataFrame]:
    """What each year's predictions are held against, as (year, rank, id, text) by name: the context copied, the corpus up
    to the year before by BM25 of the context, and by cosine with the context's mean vector (questions: embedding)."""
    spark = questions.sparkSession
    asked = spark.createDataFrame([(y - 1,) for y in years], "year int")
    best = settled(context_rows(questions, asked, max(k, context)).select((F.col("window") + 1).cast("int").alias("target"), F.col("place").alias("rank"), "id", "question_text", "embedding"))
    found = {"context_copy": best.filter(F.col("rank") <= k).select(F.col("target").alias("year"), "rank", "id", F.col("question_text").alias("text"))}
    by_words, by_vectors = [], []
    for year in years:
        corpus = questions.filter(F.col("year") < year)
        own = best.filter((F.col("target") == year) & (F.col("rank") <= context))
        scores = bm25_scores(corpus, "id", "question_text", own, "target", "question_text")
        by_words.append(top_texts(scores, "target", "id", "question_text", k))
        near = scored_against(corpus, "embedding", centroid(own, "embedding")).withColumn("target", F.lit(year))
        by_vectors.append(top_texts(near, "target", "id", "question_text", k))
    for name, parts in (("corpus_bm25", by_words), ("corpus_vectors", by_vectors)):
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        found[name] = rows.select(F.col("target").cast("int").alias("year"), "rank", "id", F.col("question_text").alias("text"))
    return found


def evaluate_run(store: Store, encoder: Encoder, years: list[int], ks: list[int], threshold: float, now: datetime, predict: str | None = None, words: int = 12) -> str:
    """Stores all metrics of a predict run (the last one by default) and returns the evaluation's id: keeping to the format,
    matching, nearness, diversity, what the three baselines reach, what the model covers beyond them, and matching at a
    controlled length."""
    run, of = run_id("eval", now), predict or store.latest_run("predict")
    preds = store.read("predictions").filter((F.col("run_id") == of) & F.col("target_year").isin(years))
    preds = settled(encoded(preds.select(F.concat_ws(":", "target_year", "model").alias("cell"), "id", "rank", F.col("target_year").alias("year"), F.col("question_predicted").alias("text"), "model"), "text", encoder))
    cells = settled(preds.select("cell", "year").distinct())
    truth = tiered(store.read("questions").filter(F.col("year").isin(years)))
    refs = settled(cells.join(truth.select("year", "id", F.col("question_text").alias("text"), "embedding"), "year").drop("year"))
    bases = {name: settled(encoded(cells.join(base, "year").drop("year"), "text", encoder)) for name, base in baselines(store.read("questions"), years, max(ks)).items()}
    out = benchmark_metrics(preds.select("cell", "id", "rank", "embedding"), refs.select("cell", "id", "embedding"), {n: b.select("cell", "id", "rank", "embedding") for n, b in bases.items()}, ks, threshold)
    for name, own in {"model": preds, **bases}.items():
        fair = E.length_controlled(own.select("cell", "id", "rank", "text"), refs.select("cell", "id", "text"), encoder, ks, threshold, words)
        fair = fair.select("cell", "k", *[F.col(c).alias(f"length_controlled_{c}_{name}") for c in ("precision", "recall")])
        out = out.unionByName(E.long_format(fair, ["cell", "k"], fair.columns[2:]))
    form = compliance(preds, ["cell"], "text").withColumn("k", F.lit(0))
    names = [c for c in form.columns if c.startswith(("frac", "mean"))]
    out = out.unionByName(E.long_format(form.select("cell", "k", *[F.col(c).alias(f"format_{c}") for c in names]), ["cell", "k"], [f"format_{c}" for c in names]))
    parts = F.split("cell", ":", 2)
    store.append("evaluations", out.select(F.xxhash64("cell", "metric", "k", F.lit(run)).alias("id"), F.get(parts, F.lit(0)).cast("int").alias("target_year"), F.get(parts, F.lit(1)).alias("model"), "metric", "k", "value", F.lit(run).alias("run_id")))
    store.log_run(run, "eval", now)
    return run


def benchmark_metrics(preds: DataFrame, refs: DataFrame, baselines: dict[str, DataFrame], ks: list[int], threshold: float) -> DataFrame:
    """(cell, k, metric, value) of every metric of vectors: matching, nearness to the threshold, diversity, and against
    each baseline its own scores, the difference in precision and what the model covers beyond it."""
    hits = E.precision_recall(preds, refs, ks, threshold)
    out = E.gated(hits).unionByName(E.long_format(E.near_threshold(preds, refs, ks, threshold), ["cell", "k"], ["frac_matched", "frac_band", "mean_best"]))
    for k in ks:
        spread = E.diversity(preds, k).withColumn("k", F.lit(k))
        out = out.unionByName(E.long_format(spread, ["cell", "k"], ["pairwise", "entropy"]))
    for name, base in baselines.items():
        theirs = E.precision_recall(base, refs, ks, threshold).select("cell", "k", F.col("precision").alias("p"), F.col("recall").alias("r"))
        wide = hits.select("cell", "k", "precision").join(theirs, ["cell", "k"]).select(
            "cell", "k", F.col("p").alias(f"baseline_{name}_precision"), F.col("r").alias(f"baseline_{name}_recall"), (F.col("precision") - F.col("p")).alias(f"delta_p_vs_{name}")
        )
        out = out.unionByName(E.long_format(wide, ["cell", "k"], [c for c in wide.columns if c not in ("cell", "k")]))
        for k in ks:
            beyond = E.beyond_retrieval(preds, base, refs, k, threshold).select("cell", F.lit(k).alias("k"), *[F.col(a).alias(f"beyond_{b}_{name}") for a, b in (("conditional_beyond", "conditional"), ("incremental_recall", "incremental"), ("n_beyond", "n_gt"), ("of_model", "of_model"), ("frac_gt", "frac_gt"))])
            out = out.unionByName(E.long_format(beyond, ["cell", "k"], [c for c in beyond.columns if c not in ("cell", "k")]))
    return out
