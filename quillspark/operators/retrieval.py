"""Lexical retrieval: BM25 and TF-IDF as joins on tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.models import Encoder, encoded
from quillspark.functions.patterns import STOP_WORDS
from quillspark.functions.text import stripped, tokens
from quillspark.operators.similarity import best_similarity

K1, B = 1.5, 0.75


def bm25_scores(corpus: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str) -> DataFrame:
    """(query, key, text, score) of the rows of the corpus that share a token with a query: a row or more (query,
    query_text) whose tokens count as a set. The corpus meets the queries on their tokens, an inverted index made on the
    fly; token counts are pre-aggregated by row, and only the queries' tokens are shuffled. Other rows score 0."""
    docs = corpus.select(key, tokens(F.col(text)).alias("__t")).withColumn("__len", F.size("__t"))
    n, average = docs.agg(F.count("*"), F.coalesce(F.avg("__len"), F.lit(0.0))).first()
    asked = queries.select(query, F.explode(tokens(F.col(query_text))).alias("token")).distinct()
    counted = docs.select(key, "__len", F.explode("__t").alias("token")).join(asked.select("token").distinct(), "token")
    tf = counted.groupBy(key, "__len", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("__len") / F.lit(average + 1e-9)))
    weighted = tf.join(df, "token").select("token", key, (idf * weight).alias("w"))
    scores = weighted.join(asked, "token").groupBy(query, key).agg(F.sum("w").alias("score"))
    return scores.join(corpus.select(key, text), key)


def top_texts(scored: DataFrame, query: str, key: str, text: str, k: int, digits: int = 9) -> DataFrame:
    """(query, rank, key, text, score): each query's k best distinct texts that aren't blank; ties go to the smaller key.
    Scores are compared at so many digits, as sums depend on their order beyond that. A task keeps k rows a query."""
    fit = scored.withColumn(text, stripped(F.col(text))).filter(F.length(text) > 0).withColumn("score", F.round("score", digits))
    best = fit.groupBy(query, text).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("key"))).alias("b"))
    found = best.select(query, text, (-F.col("b.s")).alias("score"), F.col("b.key").alias(key))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


def tfidf_vectors(docs: DataFrame, key: str, text: str, fitted: DataFrame, fitted_text: str, most: int = 8000) -> DataFrame:
    """(key, token, w): TF-IDF weights of length 1 over the ``most`` most frequent tokens of ``fitted``, stop words and
    single letters left out; idf = ln((1 + n) / (1 + df)) + 1. Rows of ``fitted`` are told apart by their text: equal texts
    count as often as they stand there."""
    stops = docs.sparkSession.createDataFrame([(w,) for w in STOP_WORDS], "token string")
    words = lambda df, k, t: df.select(*k, F.explode(tokens(F.substring(F.col(t), 1, 4000))).alias("token")).filter(F.length("token") >= 2).join(F.broadcast(stops), "token", "left_anti")
    texts = fitted.groupBy(F.col(fitted_text).alias("__text")).agg(F.count("*").alias("__times"))
    n = texts.agg(F.coalesce(F.sum("__times"), F.lit(0))).first()[0]
    counts = words(texts, ["__text", "__times"], "__text").groupBy("__text", "__times", "token").agg(F.count("*").alias("tf"))
    kept = counts.groupBy("token").agg(F.sum(F.col("tf") * F.col("__times")).alias("all"), F.sum("__times").alias("df")).orderBy(F.desc("all"), "token").limit(most)
    idf = kept.select("token", (F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    tf = words(docs, [key], text).groupBy(key, "token").agg(F.count("*").alias("tf")).join(idf, "token")
    weighted = tf.select(key, "token", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.withColumn("w", F.col("w") / norm)


def tfidf_embedded(df: DataFrame, key: str, text: str, most: int = 384, name: str = "embedding") -> DataFrame:
    """Adds TF-IDF vectors over at most so many tokens of df's own texts, in the tokens' order; rows without any are all
    zeros. What stands in for an encoder where there is none."""
    weights = tfidf_vectors(df, key, text, df, text, most)
    place = F.row_number().over(Window.orderBy("token")) - 1  # at most ``most`` tokens
    places = weights.select("token").distinct().withColumn("at", place)
    size = places.agg(F.count("*").alias("size"))
    lists = weights.join(F.broadcast(places), "token").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"))
    found = df.join(lists, key, "left").join(F.broadcast(size))
    dense = F.transform(F.sequence(F.lit(0), F.greatest(F.col("size"), F.lit(1)).cast("int") - 1), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)).cast("float"))
    return found.withColumn(name, dense).drop("m", "size")


def tfidf_best(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """(key, best): the largest TF-IDF cosine of each row of left with any of right, by whose texts it is fitted; rows
    that share no token are left out."""
    a = tfidf_vectors(left, key, text, right, text)
    b = tfidf_vectors(right, key, text, right, text).select(F.col(key).alias("other"), "token", F.col("w").alias("v"))
    pairs = a.join(b, "token").groupBy(key, "other").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    return pairs.groupBy(key).agg(F.max("cosine").alias("best"))


def tfidf_threshold(threshold: float) -> float:
    return max(0.15, threshold - 0.35)


def matched(preds: DataFrame, refs: DataFrame, threshold: float, backend: str = "embedding", encoder: Encoder | None = None) -> DataFrame:
    """(id, best, hit): how well each prediction (id, text) meets the references (id, text), by a backend: embedding (minilm,
    st and sentence-transformers say the same) by an encoder's cosines, tfidf by those of TF-IDF under its own threshold.
    Without an encoder the first falls back to the second; another backend is an error."""
    kind = (backend or "embedding").lower().strip()
    if kind not in {"embedding", "minilm", "st", "sentence-transformers", "tfidf", "tf-idf"}:
        raise ValueError(f"no matcher {backend!r}: embedding or tfidf")
    if kind.startswith("tf") or encoder is None:
        best = preds.select("id").join(tfidf_best(preds, refs, "id", "text"), "id", "left")
        return best.select("id", F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("best", F.lit(0.0)) >= tfidf_threshold(threshold)).alias("hit"))
    vectors = lambda df: encoded(df.withColumn("text", F.substring("text", 1, 4000)), "text", encoder).withColumn("cell", F.lit("all"))
    best = best_similarity(vectors(preds), vectors(refs), "cell").select(F.col("key").alias("id"), "best")
    return preds.select("id").join(best, "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce(F.col("best") >= threshold, F.lit(False)).alias("hit"))
