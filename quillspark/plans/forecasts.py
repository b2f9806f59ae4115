"""Forecasters, what they are held against, and models at work with stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.models import EchoGenerator, HashingEncoder, Loaded, PromptScorer, encoded
from quillspark.operators import drivers as R
from quillspark.operators import evaluate as E
from quillspark.operators import forecast as G
from quillspark.operators import generate as M
from quillspark.operators.retrieval import matched, tfidf_embedded
from quillspark.plans import common as C
from quillspark.plans import sqltext as Q
from quillspark.sources.tables import articles, citations, settled

YEARS, K = (2019, 2020, 2021), 20


def _years(spark):
    return spark.createDataFrame([(y,) for y in YEARS], "year int")


def _cells(spark, sf_dir):
    found = G.contexts(C.questions(spark, sf_dir), spark.createDataFrame([(y - 1,) for y in YEARS], "year int"), 30)
    return found.select(F.lit("echo").alias("model"), F.col("year").alias("context_year"), (F.col("year") + 1).cast("int").alias("target_year"), "context")


def impact_table(spark, sf_dir):
    """Citations a year of every article, and whether they are among the highest of its year."""
    found = R.impact_table(articles(spark, sf_dir), citations(spark, sf_dir), C.REF_YEAR)
    return found.select("pmid", "year", F.round("rate", 6).alias("rate"), "is_critical")


def predict_frequency(spark, sf_dir):
    """The most frequent questions of the year before, for three years."""
    return G.frequency_forecast(C.questions(spark, sf_dir), _years(spark), K)


def predict_random(spark, sf_dir):
    """Questions of the years before in hash order, for three years."""
    return G.random_forecast(C.questions(spark, sf_dir), _years(spark), K)


def _based(spark, sf_dir):
    # A checkpoint, as each year's baselines read the questions several times; without vectors, which are larger than texts.
    questions = encoded(settled(C.questions(spark, sf_dir)), "question_text", HashingEncoder())
    return R.baselines(questions, list(YEARS), K)


def baseline_context(spark, sf_dir):
    """The best questions of the years before, copied."""
    return _based(spark, sf_dir)["context_copy"]


def baseline_bm25(spark, sf_dir):
    """The questions of the years before that meet the context best by BM25."""
    return _based(spark, sf_dir)["corpus_bm25"]


def baseline_vectors(spark, sf_dir):
    """The questions of the years before that are nearest to the context's mean vector, by the stand-in encoder."""
    return _based(spark, sf_dir)["corpus_vectors"]


def _texts(spark, sf_dir):
    preds = C.predictions(spark, sf_dir).select(F.col("target_year").cast("string").alias("cell"), F.concat_ws(":", "target_year", "model", "rank").alias("id"), "rank", "text")
    refs = C.questions(spark, sf_dir).filter("year between 2023 and 2025").select(F.col("year").cast("string").alias("cell"), F.col("id").cast("string").alias("id"), F.col("question_text").alias("text"))
    return preds, refs


def eval_length_controlled(spark, sf_dir):
    """Matching of predictions and questions that are cut to twelve words, by the stand-in encoder."""
    preds, refs = _texts(spark, sf_dir)
    found = E.length_controlled(preds, refs, HashingEncoder(), [10, 50], 0.5)
    return found.select("cell", "k", "n_preds", "n_gt", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def match_fallback(spark, sf_dir):
    """Predictions matched with questions where there is no encoder."""
    preds, refs = _texts(spark, sf_dir)
    return matched(preds, refs, 0.5, "minilm").select("id", F.round("best", 6).alias("best"), "hit")


def embed_tfidf(spark, sf_dir):
    """TF-IDF vectors of questions, as digests."""
    found = tfidf_embedded(C.questions(spark, sf_dir).select("id", "question_text"), "id", "question_text")
    return found.select("id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("square"))


def lm_generation(spark, sf_dir):
    """Lists of ten directions for three years, from prompts that tell what is listed already, by the stand-ins."""
    return M.listed(_cells(spark, sf_dir), Loaded(EchoGenerator), PromptScorer(), HashingEncoder(), 10, each=15)


def lm_batch(spark, sf_dir):
    """Lists of ten directions for three years from one instruction each, by the stand-ins."""
    return M.listed_at_once(_cells(spark, sf_dir), Loaded(EchoGenerator), PromptScorer(), 10, style="instruct")


def lm_extraction(spark, sf_dir):
    """The direction that the stand-in draws from each article."""
    found = M.extracted(articles(spark, sf_dir), Loaded(EchoGenerator))
    return found.select("pmid", "question", F.round("qc_score", 6).alias("qc_score"), "segmentation_method")


QUERIES = {f.__name__: f for f in (
    impact_table, predict_frequency, predict_random, baseline_context, baseline_bm25, baseline_vectors, eval_length_controlled, match_fallback,
    embed_tfidf, lm_generation, lm_batch, lm_extraction,
)}


def _oracle() -> dict[str, str]:
    q = C.QUESTIONS_SQL.strip()
    years = ", ".join(f"({y})" for y in YEARS)
    targets = f"tg as (select target::int target from (values {years}) v(target))"
    best = """sp as (select target, q.*, row_number() over (partition by target order by coalesce(impact_score, 0) desc, year desc, question_text, id)::int place
        from tg join questions q on q.year between target - 6 and target - 1)"""
    return {
        "impact_table": f"with {q} select w.pmid, w.year, round(w.rate, 6) rate, case when w.rate >= t.thr and w.rate > 0 then 1 else 0 end::int is_critical from w join t on w.year = t.year where w.year between 2000 and 2027",
        "predict_frequency": f"with {q}, {targets}, fc as (select target target_year, question_text as text, count(*)::double score from tg join questions on year = target - 1 group by all), fr as (select target_year, (row_number() over (partition by target_year order by score desc, text))::int rank, text, score from fc) select * from fr where rank <= {K}",
        "predict_random": f"with {q}, {targets}, d as (select distinct target target_year, question_text as text from tg join questions on year between target - 6 and target - 1), fr as (select target_year, (row_number() over (partition by target_year order by md5('42:' || target_year || ':' || text), text))::int rank, text, 0.0::double score from d) select * from fr where rank <= {K}",
        "baseline_context": f"with {q}, {targets}, {best} select target as year, place as rank, id, question_text as text from sp where place <= {K}",
        "baseline_bm25": f"""with {q}, {targets}, {best}, cp as (select target, id, question_text, {Q.tokens('question_text')} t from tg join questions on year < target),
            st as (select target, count(*)::double nn, avg(len(t)) al from cp group by target), qt as (select distinct target, unnest({Q.tokens('question_text')}) token from sp where place <= 30),
            u as (select target, id, len(t) dl, unnest(t) token from cp), tf as (select target, id, dl, token, count(*) tf from u join qt using (target, token) group by all),
            df as (select target, token, count(*) df from tf group by target, token),
            sc as (select target, id, sum(ln(1 + (nn - df + 0.5) / (df + 0.5)) * (tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / (al + 1e-9))))) s from tf join df using (target, token) join st using (target) group by target, id),
            x as (select sc.target, cp.id, {Q.stripped('question_text')} text, round(s, 9) s from cp join sc on cp.id = sc.id and cp.target = sc.target), y as (select target, text, min((-s, id)) b from x where text <> '' group by 1, 2),
            z as (select target as year, (row_number() over (partition by target order by b[1], b[2]))::int rank, b[2] id, text from y) select * from z where rank <= {K}""",
    }


ORACLE = _oracle()
