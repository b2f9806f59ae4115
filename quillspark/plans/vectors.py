"""Evaluation queries over the embeddings table: odd ids predict, even ids are to be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.patterns import STOP_WORDS
from quillspark.functions.text import trigrams, verbatim_key
from quillspark.operators import evaluate as E
from quillspark.operators import retrieval as R
from quillspark.operators.ranking import at_each_k, ranked
from quillspark.operators.similarity import centroid, scored_against
from quillspark.plans import common as C
from quillspark.plans import sqltext as Q
from quillspark.sources.tables import spread, table

TAU, KS = 0.30, [10, 50]
#: The last k is above the size of the cells, so that the gate closes for it.
GATED_KS = [10, 50, 1000]


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 3).cast("int").alias("cell"), F.col("vec_id").alias("id"), "embedding")


def _preds(spark, sf_dir):
    return ranked(_vectors(spark, sf_dir).filter("id % 2 = 1"), ["cell"], [F.col("id")])


def _refs(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("id % 2 = 0")


def _some(spark, sf_dir, rest):
    return ranked(_vectors(spark, sf_dir).filter(f"id % 4 = {rest}"), ["cell"], [F.col("id")])


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def vec_best_similarity(spark, sf_dir):
    found = E.best_of_predictions(_preds(spark, sf_dir), _refs(spark, sf_dir))
    return found.select("cell", "id", F.round("best", 6).alias("best"))


def vec_precision_recall(spark, sf_dir):
    return _rounded(E.precision_recall(_preds(spark, sf_dir), _refs(spark, sf_dir), KS, TAU))


def vec_gated_metrics(spark, sf_dir):
    """Long-format metrics of all predictions; cells with too few of them for k say so instead."""
    return _rounded(E.gated(E.precision_recall(_preds(spark, sf_dir), _refs(spark, sf_dir), GATED_KS, TAU)))


def vec_uncovered(spark, sf_dir):
    return E.uncovered(_preds(spark, sf_dir), _refs(spark, sf_dir), 50, TAU)


def vec_near_threshold(spark, sf_dir):
    return _rounded(E.near_threshold(_preds(spark, sf_dir), _refs(spark, sf_dir), KS, TAU))


def vec_diversity(spark, sf_dir):
    return _rounded(E.diversity(_preds(spark, sf_dir), 50))


def vec_recycling(spark, sf_dir):
    return _rounded(E.recycling_rate(_some(spark, sf_dir, 1), _some(spark, sf_dir, 3), TAU))


def vec_beyond_retrieval(spark, sf_dir):
    """What predictions 1 mod 4 cover that 3 mod 4 don't."""
    return _rounded(E.beyond_retrieval(_some(spark, sf_dir, 1), _some(spark, sf_dir, 3), _refs(spark, sf_dir), 50, TAU))


def vec_composites(spark, sf_dir):
    """Extension and novelty in long format, from precision and recycling."""
    hits = E.precision_recall(_preds(spark, sf_dir), _refs(spark, sf_dir), KS, TAU).select("cell", "k", "precision")
    rates = E.recycling_rate(_preds(spark, sf_dir), _some(spark, sf_dir, 2), TAU).withColumnRenamed("rate", "context")
    more = E.recycling_rate(_preds(spark, sf_dir), _some(spark, sf_dir, 0), TAU).withColumnRenamed("rate", "corpus")
    made = E.composites(F.col("precision"), F.col("context"), F.col("corpus"))
    wide = hits.join(rates, "cell").join(more, "cell").select("cell", "k", *[c.alias(n) for n, c in made.items()])
    return _rounded(E.long_format(wide, ["cell", "k"], list(made)))


def vec_threshold_sweep(spark, sf_dir):
    """Mean precision over cells at several thresholds, from one table of best cosines."""
    best = at_each_k(E.best_of_predictions(_preds(spark, sf_dir), _refs(spark, sf_dir)), [50])
    taus = best.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in (0.2, 0.25, 0.3, 0.35, 0.4)])))
    cells = taus.groupBy("tau", "cell").agg(F.avg((F.col("best") >= F.col("tau")).cast("double")).alias("p"))
    return _rounded(cells.groupBy("tau").agg(F.avg("p").alias("precision")))


def vec_centroid_topk(spark, sf_dir):
    """The vectors nearest to the mean of those of label 0."""
    rows = table(spark, sf_dir, "embeddings")
    centre = centroid(rows.filter("label = 0"), "embedding")
    best = scored_against(rows, "embedding", centre).select("vec_id", F.round("score", 6).alias("score"))
    return best.orderBy(F.desc("score"), "vec_id").limit(20)


def ir_bm25_topk(spark, sf_dir):
    """The best questions for each benchmark item whose id is divisible by 20."""
    queries = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select("item_id", "text")
    scores = R.bm25_scores(C.questions(spark, sf_dir), "id", "question_text", queries, "item_id", "text")
    return R.top_texts(scores, "item_id", "id", "question_text", 20).select("item_id", "rank", "id", "question_text", F.round("score", 6).alias("score"))


def ir_tfidf_best(spark, sf_dir):
    """The best TF-IDF cosine of each prediction with a question, and whether it matches."""
    preds = C.predictions(spark, sf_dir).select(F.concat_ws(":", "target_year", "model", "rank").alias("id"), "text")
    refs = C.questions(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("question_text").alias("text"))
    best = R.tfidf_best(preds, refs, "id", "text")
    return best.select("id", F.round("best", 6).alias("best"), (F.col("best") >= R.tfidf_threshold(0.5)).alias("matched"))


def div_trigram_ratio(spark, sf_dir):
    """Distinct over all three-token runs of each model's predictions."""
    grams = C.predictions(spark, sf_dir).select("model", F.explode(trigrams(F.col("text"))).alias("g"))
    counts = grams.groupBy("model", "g").agg(F.count("*").alias("n"))
    return counts.groupBy("model").agg(F.round(F.count("*") / F.sum("n"), 6).alias("ratio"))


def audit_verbatim(spark, sf_dir):
    """The share of predictions that stand word for word among the documents' lines."""
    known = C.lines(spark, sf_dir).select(verbatim_key(F.col("line")).alias("key")).distinct().withColumn("hit", F.lit(1.0))
    preds = C.predictions(spark, sf_dir).select("model", verbatim_key(F.col("text")).alias("key"))
    joined = preds.join(known, "key", "left")
    return joined.groupBy("model").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("rate"))


def audit_passages(spark, sf_dir):
    """Benchmark passages that stand whole in a document. Ids meet first, on up to four of a passage's inner words, which
    are whole words of the document wherever the passage begins; texts are joined and compared after that."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    keyed = items.withColumn("w", F.split("item", r"\s+")).withColumn("n", F.least(F.size("w") - 2, F.lit(4)))
    inner = keyed.filter("n > 0").select("item_id", "n", F.array_join(F.slice("w", F.lit(2), F.col("n")), " ").alias("h"))
    sizes = sorted(r.n for r in inner.select("n").distinct().collect())  # four at most
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = spread(docs).select("doc_id", F.split("text", r"\s+").alias("w"))
    runs_of = lambda n: F.transform("w", lambda _, i: F.array_join(F.slice(F.col("w"), i + 1, n), " "))
    runs = [runs_of(n) for n in sizes]
    starts = words.select("doc_id", F.explode(F.array_distinct(F.concat(*runs))).alias("h")) if sizes else words.select("doc_id", F.lit("").alias("h")).limit(0)
    pairs = starts.join(inner, "h").select("doc_id", "item_id").distinct()
    found = pairs.join(items, "item_id").join(docs, "doc_id").filter(F.contains("text", "item")).select("item_id", "doc_id")
    # Passages of one or two words have no inner word: each is looked for in every document.
    short = keyed.filter("n <= 0").select("item_id", "item")
    return found.union(docs.join(F.broadcast(short), F.contains("text", "item")).select("item_id", "doc_id")) if not short.isEmpty() else found


def report_markdown(spark, sf_dir):
    """The metrics as lines of a report."""
    found = E.long_format(E.precision_recall(_preds(spark, sf_dir), _refs(spark, sf_dir), KS, TAU), ["cell", "k"], ["precision", "recall"])
    rows = found.select((2023 + F.col("cell")).alias("target_year"), F.lit("m").alias("model"), "metric", "k", "value")
    return E.report_lines(rows)


QUERIES = {f.__name__: f for f in (
    vec_best_similarity, vec_precision_recall, vec_gated_metrics, vec_uncovered, vec_near_threshold, vec_diversity, vec_recycling,
    vec_beyond_retrieval, vec_composites, vec_threshold_sweep, vec_centroid_topk, ir_bm25_topk, ir_tfidf_best, div_trigram_ratio,
    audit_verbatim, audit_passages, report_markdown,
)}

_V = f"""
v as (select cast(label % 3 as int) cell, vec_id id, embedding::double[] e from embeddings),
pr as (select *, row_number() over (partition by cell order by id) rank from v where id % 2 = 1),
rf as (select * from v where id % 2 = 0),
m1 as (select *, row_number() over (partition by cell order by id) rank from v where id % 4 = 1),
m3 as (select *, row_number() over (partition by cell order by id) rank from v where id % 4 = 3),
ks as (select unnest([10, 50])::int k),
sim as (select p.cell, p.id pid, r.id rid, p.rank, list_dot_product(p.e, r.e) s from pr p join rf r on p.cell = r.cell),
bp as (select cell, pid, any_value(rank) rank, max(s) best from sim group by cell, pid),
br as (select cell, rid, k, max(s) filter (rank <= k) best from sim, ks group by cell, rid, k),
hp as (select cell, k, count(*) n_preds, avg((best >= {TAU})::int::double) "precision" from bp, ks where rank <= k group by cell, k),
hr as (select cell, k, count(*) n_gt, count(*) filter (best >= {TAU}) covered from br group by cell, k),
prk as (select hp.cell, hp.k, n_preds, n_gt, least(1.0::double, n_preds / hp.k::double) coverage, "precision", covered / n_gt::double recall,
               covered / least(hp.k, n_gt)::double recall_norm from hp join hr on hp.cell = hr.cell and hp.k = hr.k)
"""
_G = _V.replace(str(KS), str(GATED_KS))
_COVER = "select r.cell, r.id, coalesce(max(list_dot_product(p.e, r.e)) >= {0}, false) hit from rf r left join {1} p on p.cell = r.cell and p.rank <= 50 group by all"
_REC = "select p.cell, p.id, max(list_dot_product(p.e, c.e)) >= {0} hit from {1} p join {2} c on p.cell = c.cell group by all"


def _stops() -> str:
    """The stop words as SQL literals."""
    return ", ".join("'" + word.replace("'", "''") + "'" for word in STOP_WORDS)


def _oracle() -> dict[str, str]:
    grams = "case when len(t) >= 3 then list_transform(range(1, len(t) - 1), lambda k: array_to_string(t[k:k + 2], ' ')) when len(t) > 0 then [array_to_string(t, ' ')] else [] end"
    key = lambda x: f"array_to_string({Q.words(f'lower({x})')}, ' ')"
    return {
        "vec_best_similarity": f"with {_V} select cell, pid id, round(best, 6) best from bp",
        "vec_precision_recall": f"with {_V} select cell, k, n_preds, n_gt, round(coverage, 6) coverage, round(\"precision\", 6) \"precision\", round(recall, 6) recall, round(recall_norm, 6) recall_norm, round(least(1.0::double, recall_norm), 6) recall_bounded from prk",
        "vec_gated_metrics": f"with {_G}, l as (unpivot (select cell, k, coverage, case when coverage >= 0.5 then \"precision\" end \"precision\", case when coverage >= 0.5 then recall end recall, case when coverage >= 0.5 then recall_norm end recall_norm, case when coverage < 0.5 then 1.0::double end precision_skipped from prk) on coverage, \"precision\", recall, recall_norm, precision_skipped into name metric value value) select cell, k, metric, round(value, 6) as value from l",
        "vec_uncovered": f"with {_V} select cell, rid id from br where k = 50 and coalesce(best < {TAU}, true)",
        "vec_near_threshold": f"with {_V} select cell, k, round(avg((best >= {TAU})::int::double), 6) frac_matched, round(avg((best >= {TAU - E.BAND} and best < {TAU})::int::double), 6) frac_band, round(avg(best), 6) mean_best, round(quantile_cont(best, 0.1), 6) p10_best, round(quantile_cont(best, 0.5), 6) p50_best from bp, ks where rank <= k group by cell, k",
        "vec_diversity": f"""with {_V}, t as (select * from pr where rank <= 50), d as (select cell, unnest(e) x, generate_subscripts(e, 1) i from t),
            c0 as (select cell, i, avg(x) x from d group by cell, i), c1 as (select cell, list(x order by i) c from c0 group by cell),
            c as (select cell, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-9)) c from c1),
            z as (select t.cell, list_dot_product(t.e, c.c) / 0.1 z from t join c on t.cell = c.cell),
            p as (select *, exp(z - max(z) over (partition by cell)) / sum(exp(z)) over (partition by cell) * exp(max(z) over (partition by cell)) p from z),
            h as (select cell, count(*) n, -sum(p * ln(p + 1e-12)) / ln(count(*)) entropy from p group by cell),
            w as (select a.cell, avg(1 - list_dot_product(a.e, b.e)) pairwise from t a join t b on a.cell = b.cell and a.id < b.id group by a.cell)
            select h.cell, n, round(pairwise, 6) pairwise, round(entropy, 6) entropy from h join w on h.cell = w.cell""",
        "vec_recycling": f"with {_V}, x as ({_REC.format(TAU, 'm1', 'm3')}) select cell, round(avg(hit::int::double), 6) rate from x group by cell",
        "vec_beyond_retrieval": f"""with {_V}, a as ({_COVER.format(TAU, 'm1')}), b as ({_COVER.format(TAU, 'm3')}),
            n as (select a.cell, count(*) n_gt, count(*) filter (a.hit) n_model, count(*) filter (b.hit) n_baseline, count(*) filter (a.hit and not b.hit) n_beyond, count(*) filter (a.hit or b.hit) n_union from a join b on a.cell = b.cell and a.id = b.id group by a.cell)
            select *, round((n_union - n_baseline) / n_gt::double, 6) incremental_recall, case when n_gt > n_baseline then round(n_beyond / (n_gt - n_baseline)::double, 6) else 0.0 end::double conditional_beyond,
              case when n_model > 0 then round(n_beyond / n_model::double, 6) else 0.0 end::double of_model, round(n_beyond / n_gt::double, 6) frac_gt from n""",
        "vec_composites": f"""with {_V}, v2 as (select * from v where id % 4 = 2), v0 as (select * from v where id % 4 = 0), x2 as ({_REC.format(TAU, 'pr', 'v2')}), x0 as ({_REC.format(TAU, 'pr', 'v0')}),
            r2 as (select cell, avg(hit::int::double) a from x2 group by cell), r0 as (select cell, avg(hit::int::double) b from x0 group by cell),
            w as (select hp.cell, k, "precision" - a extension_vs_context, "precision" - b extension_vs_corpus, "precision" - 0.5::double * (a + b) novelty from hp join r2 on hp.cell = r2.cell join r0 on hp.cell = r0.cell),
            l as (unpivot w on extension_vs_context, extension_vs_corpus, novelty into name metric value value)
            select cell, k, metric, round(value, 6) as value from l""",
        "vec_threshold_sweep": f"with {_V}, t as (select unnest([0.2, 0.25, 0.3, 0.35, 0.4])::double tau), c as (select tau, cell, avg((best >= tau)::int::double) p from bp, t where rank <= 50 group by tau, cell) select tau, round(avg(p), 6) \"precision\" from c group by tau",
        "vec_centroid_topk": "with d as (select unnest(embedding::double[]) x, generate_subscripts(embedding, 1) i from embeddings where label = 0), c0 as (select i, avg(x) x from d group by i), c1 as (select list(x order by i) c from c0), s as (select vec_id, round(list_dot_product(embedding::double[], c) / (sqrt(list_dot_product(c, c)) + 1e-9), 6) score from embeddings, c1) select vec_id, score from s order by score desc, vec_id limit 20",
        "ir_bm25_topk": f"""with {C.QUESTIONS_SQL}, dt as (select id, {Q.tokens('question_text')} t from questions), st as (select count(*)::double nn, avg(len(t)) al from dt),
            q as (select distinct item_id, unnest({Q.tokens('text')}) token from benchmark where item_id % 20 = 0), u as (select id, len(t) dl, unnest(t) token from dt), tf as (select id, dl, token, count(*) tf from u where token in (select token from q) group by all),
            df as (select token, count(*) df from tf group by token), sc as (select item_id, id, sum(ln(1 + (nn - df + 0.5) / (df + 0.5)) * (tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / (al + 1e-9))))) s from tf join df using (token) join q using (token), st group by item_id, id),
            x as (select item_id, questions.id, {Q.stripped('question_text')} question_text, round(s, 9) s from questions join sc on questions.id = sc.id), y as (select item_id, question_text, min((-s, id)) b from x where question_text <> '' group by 1, 2),
            z as (select item_id, (row_number() over (partition by item_id order by b[1], b[2]))::int rank, b[2] id, question_text, round(-b[1], 6) score from y)
            select * from z where rank <= 20""",
        "ir_tfidf_best": f"""with {C.QUESTIONS_SQL.strip()}, {C.PREDICTIONS_SQL.strip()}, stops as (select unnest([{_stops()}]) token),
            rd as (select id::varchar id, question_text t from questions), pd as (select target_year || ':' || model || ':' || rank as id, text t from predictions),
            rt as (select id, unnest({Q.tokens('t[1:4000]')}) token from rd), pt as (select id, unnest({Q.tokens('t[1:4000]')}) token from pd),
            rf as (select id, token, count(*) tf from rt where length(token) >= 2 and token not in (select token from stops) group by all), pf as (select id, token, count(*) tf from pt where length(token) >= 2 and token not in (select token from stops) group by all),
            nn as (select count(*) n from rd), kp as (select token, sum(tf) al, count(*) df from rf group by token order by al desc, token limit 8000), idf as (select token, ln((1.0::double + n) / (1.0::double + df)) + 1.0::double idf from kp, nn),
            rw as (select id, token, tf * idf w from rf join idf using (token)), pw as (select id, token, tf * idf w from pf join idf using (token)),
            rn as (select id, token, w / sqrt(sum(w * w) over (partition by id)) w from rw), pn as (select id, token, w / sqrt(sum(w * w) over (partition by id)) w from pw),
            cs as (select pn.id, rn.id other, sum(pn.w * rn.w) s from pn join rn using (token) group by all) select id, round(max(s), 6) best, max(s) >= {R.tfidf_threshold(0.5)} matched from cs group by id""",
        "div_trigram_ratio": f"with {C.PREDICTIONS_SQL}, t as (select model, {Q.tokens('text')} t from predictions), g as (select model, unnest({grams}) g from t) select model, round(count(distinct g) / count(*)::double, 6) ratio from g group by model",
        "audit_verbatim": f"with {C.LINES_SQL.strip()}, {C.PREDICTIONS_SQL.strip()}, kn as (select distinct {key('line')} k from lines) select model, round(avg(({key('text')} in (select k from kn))::int::double), 6) rate from predictions group by model",
        "audit_passages": "select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)",
        "report_markdown": f"""with {_V}, l as (unpivot (select cell, k, "precision", recall from prk) on "precision", recall into name metric value value)
            select (row_number() over (order by 2023 + cell, metric, k))::int place, printf('| %s | m | %s | %s | %.3f |', (2023 + cell)::varchar, metric, k::varchar, value) line from l""",
    }


ORACLE = _oracle()
