"""Worklists, counts, top-k, ground-truth pools and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import ranking as R
from quillspark.operators.pools import context_window, tiered
from quillspark.operators.store import merge_upsert
from quillspark.plans import common as C
from quillspark.sources.tables import articles, citations, table


def join_anti_citations(spark, sf_dir):
    """Articles with a year whose citations are still to be fetched."""
    found = articles(spark, sf_dir).filter("year is not null")
    return found.join(citations(spark, sf_dir), "pmid", "left_anti").select("pmid", "year")


def join_anti_worklist(spark, sf_dir):
    """The first hundred articles without a segment, by id."""
    todo = articles(spark, sf_dir).select("pmid", "year").join(C.segments(spark, sf_dir).select("pmid"), "pmid", "left_anti")
    return todo.orderBy("pmid").limit(100)


def join_semi_ids(spark, sf_dir):
    """Articles of an id list that have no segment yet."""
    ids = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("pmid"))
    found = articles(spark, sf_dir).select("pmid", "year").join(ids, "pmid", "left_semi")
    return found.join(C.segments(spark, sf_dir).select("pmid"), "pmid", "left_anti")


def join_left_citations(spark, sf_dir):
    joined = articles(spark, sf_dir).select("pmid", "year").join(citations(spark, sf_dir), "pmid", "left")
    return joined.select("pmid", "year", F.coalesce("citation_count", F.lit(0)).alias("citation_count"))


def join_segments_articles_impact(spark, sf_dir):
    """Segments with their article's year and the impact, where there is one."""
    impact = C.questions(spark, sf_dir).filter("is_critical = 1").select("pmid", "impact_score")
    found = C.segments(spark, sf_dir).join(articles(spark, sf_dir).select("pmid", "year"), "pmid").join(impact, "pmid", "left")
    return found.select("pmid", "year", "qc_score", F.round("impact_score", 6).alias("impact_score"))


def agg_index_counts(spark, sf_dir):
    """Readiness counts of articles in one pass."""
    arts = articles(spark, sf_dir).select("pmid", "year").join(citations(spark, sf_dir), "pmid", "left")
    arts = arts.join(C.segments(spark, sf_dir).select("pmid", F.lit(1).alias("seg")), "pmid", "left")
    return arts.agg(
        F.count("*").alias("articles"), F.count("year").alias("with_year"), F.count("citation_count").alias("cited"),
        F.count("seg").alias("segmented"), F.count_if(F.col("seg").isNull()).alias("missing_directions"),
    )


def agg_frequency_topk(spark, sf_dir):
    """The most frequent topic lines, as a forecaster that repeats the past."""
    counted = C.questions(spark, sf_dir).groupBy("question_text").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "question_text").limit(20)


def agg_years(spark, sf_dir):
    return C.questions(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), F.sum("is_critical").alias("critical"))


def agg_latest_run(spark, sf_dir):
    """The last run of each stage, with events as the run log."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.concat(F.lit("run_"), F.col("event_id")).alias("run_id"), "ts", "event_id")
    return runs.groupBy("stage").agg(F.max_by("run_id", F.struct("ts", "event_id")).alias("run_id"))


def topk_context(spark, sf_dir):
    """The context of 2021: the best 30 of six years."""
    return context_window(C.questions(spark, sf_dir), 2020, 30).select("id", "year", "question_text")


def topk_fraction_per_year(spark, sf_dir):
    """The best seven tenths of each year, forty at most."""
    order = [F.desc(F.coalesce("impact_score", F.lit(0.0))), F.col("question_text"), F.col("id")]
    return R.top_fraction(C.questions(spark, sf_dir), ["year"], order, 0.7, 40).select("id", "year")


def pool_ground_truth(spark, sf_dir):
    return tiered(C.questions(spark, sf_dir)).select("id", "year", "tier")


def pool_ground_truth_any(spark, sf_dir):
    return tiered(C.questions(spark, sf_dir), clean=False).select("id", "year", "tier")


def rank_predictions(spark, sf_dir):
    return C.predictions(spark, sf_dir)


def rank_at_each_k(spark, sf_dir):
    found = R.at_each_k(C.predictions(spark, sf_dir), [3, 10])
    return found.groupBy("target_year", "model", "k").agg(F.count("*").alias("n"))


def dedup_first_occurrence(spark, sf_dir):
    """The first of equal lines of each document."""
    found = C.lines(spark, sf_dir).filter("line <> ''")
    first = R.first_occurrences(found, ["id"], F.lower("line"), [F.col("pos")])
    return first.groupBy("id").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


def pairs_next_year(spark, sf_dir):
    """How many context and target questions each year's training pairs have; the year itself must have questions."""
    counts = C.questions(spark, sf_dir).filter("year <= 2020").groupBy("year").agg(F.count("*").alias("n"))
    target = counts.select((F.col("year") - 1).alias("year"), F.col("n").alias("n_target"))
    return counts.join(target, "year").select("year", F.col("n").alias("n_context"), "n_target")


def sample_uniform(spark, sf_dir):
    return R.sampled(C.questions(spark, sf_dir).filter("year < 2023"), 50, 42, "question_text", "id").select("id")


def sample_weighted(spark, sf_dir):
    return R.sampled_by_weight(C.questions(spark, sf_dir), ["year"], 5, 42, "question_text", F.col("impact_score"), "id").select("id", "year")


def sample_split(spark, sf_dir):
    keyed = C.questions(spark, sf_dir).withColumn("key", F.concat_ws(":", "question_text", "id"))
    return R.split_off(keyed, 0.1, 42, "key").select("id", "part")


def sample_pairs(spark, sf_dir):
    """Fifty questions of 2020, each with a distractor of the years before, drawn with replacement by a hash."""
    qs = C.questions(spark, sf_dir)
    real = R.sampled(qs.filter("year = 2020"), 50, 42, "question_text", "id").select(F.col("id").alias("real_id"), "question_text")
    pool = qs.filter("year < 2020").select("id")
    n = pool.count()
    numbered = pool.withColumn("place", F.row_number().over(Window.orderBy("id")) - 1)
    drawn = real.withColumn("place", F.pmod(F.conv(F.substring(R.draw_key(7, F.col("question_text")), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1))))
    return drawn.join(numbered, "place").select("real_id", F.col("id").alias("distractor_id"))


def store_upsert(spark, sf_dir):
    """Articles after an upsert: even ids get a new year, new ids come, of equal ids in the delta the last wins."""
    base = articles(spark, sf_dir).select("pmid", "year")
    old = base.filter("cast(pmid as long) % 2 = 0").select("pmid", (F.col("year") + 100).alias("year"), F.lit(1).alias("version"))
    again = old.filter("cast(pmid as long) % 4 = 0").select("pmid", (F.col("year") + 100).alias("year"), F.lit(2).alias("version"))
    new = base.filter("cast(pmid as long) % 10 = 1").select(F.concat(F.lit("n"), "pmid").alias("pmid"), "year", F.lit(1).alias("version"))
    return merge_upsert(base, old.union(again).union(new), ["pmid"], [F.desc("version")])


def store_segment_method(spark, sf_dir):
    """The method after a segment's text was drawn anew."""
    m = F.col("segmentation_method")
    return C.segments(spark, sf_dir).select("pmid", F.when(m.like("%+subject"), m).otherwise(F.concat(F.coalesce(m, F.lit("hybrid")), F.lit("+subject"))).alias("method"))


_DELTA = """
base as (select cast(doc_id as varchar) pmid, cast(2000 + doc_id % 27 as int) as year from documents),
d as (select pmid, year + case when pmid::bigint % 4 = 0 then 200 else 100 end as year from base where pmid::bigint % 2 = 0
      union all select 'n' || pmid, year from base where pmid::bigint % 10 = 1)
"""
_ARTS = "arts as (select cast(doc_id as varchar) pmid, cast(2000 + doc_id % 27 as int) as year from documents), cits as (select cast(l_partkey as varchar) pmid, count(*) citation_count from lineitem where l_partkey % 3 <> 0 group by 1)"
_Q, _S, _P, _L = C.QUESTIONS_SQL, C.SEGMENTS_SQL, C.PREDICTIONS_SQL, C.LINES_SQL
_U = "('0x' || substr(md5('{0}:' || {1}), 1, 8))::bigint"

QUERIES = {f.__name__: f for f in (
    join_anti_citations, join_anti_worklist, join_semi_ids, join_left_citations, join_segments_articles_impact, agg_index_counts,
    agg_frequency_topk, agg_years, agg_latest_run, topk_context, topk_fraction_per_year, pool_ground_truth, pool_ground_truth_any,
    rank_predictions, rank_at_each_k, dedup_first_occurrence, pairs_next_year, sample_uniform, sample_weighted, sample_split, sample_pairs,
    store_upsert, store_segment_method,
)}


def _oracle() -> dict[str, str]:
    from quillspark.plans.sqltext import clean_truth

    pool = """, m as (select *, case when is_critical = 1 and ok then 1 when not ok then 3 else 2 end tier from
               (select *, {0} as ok from questions) q),
             b as (select year, min(tier) best from m group by year)
             select id, m.year, cast(best as int) tier from m join b on m.year = b.year where tier <= best"""
    return {
        "join_anti_citations": f"with {_ARTS} select pmid, year from arts where pmid not in (select pmid from cits)",
        "join_anti_worklist": f"with {_ARTS}, {_S} select pmid, year from arts where pmid not in (select pmid from segments) order by pmid limit 100",
        "join_semi_ids": f"with {_ARTS}, {_S} select pmid, year from arts where pmid in (select c_custkey::varchar from customer where c_custkey % 2 = 0) and pmid not in (select pmid from segments)",
        "join_left_citations": f"with {_ARTS} select arts.pmid, year, coalesce(citation_count, 0) citation_count from arts left join cits using (pmid)",
        "join_segments_articles_impact": f"with {_Q}, {_S} select s.pmid, cast(2000 + s.pmid::bigint % 27 as int) as year, qc_score, round(q.impact_score, 6) impact_score from segments s left join (select * from questions where is_critical = 1) q on s.pmid = q.pmid",
        "agg_index_counts": f"with {_ARTS}, {_S} select count(*) articles, count(year) with_year, count(citation_count) cited, count(s.pmid) segmented, count(*) - count(s.pmid) missing_directions from arts left join cits using (pmid) left join segments s on s.pmid = arts.pmid",
        "agg_frequency_topk": f"with {_Q} select question_text, count(*) n from questions group by 1 order by n desc, question_text limit 20",
        "agg_years": f"with {_Q} select year, count(*) n, sum(is_critical)::bigint critical from questions group by 1",
        "agg_latest_run": "select event_type as stage, 'run_' || arg_max(event_id, (ts, event_id)) as run_id from events group by 1",
        "topk_context": f"with {_Q} select id, year, question_text from questions where year between 2015 and 2020 order by coalesce(impact_score, 0) desc, year desc, question_text, id limit 30",
        "topk_fraction_per_year": f"with {_Q}, k as (select *, row_number() over (partition by year order by coalesce(impact_score, 0) desc, question_text, id) rk, count(*) over (partition by year) m from questions) select id, year from k where rk <= least(40, greatest(1, floor(m * 0.7::double)))",
        "pool_ground_truth": f"with {_Q}" + pool.format(clean_truth("question_text")),
        "pool_ground_truth_any": f"with {_Q}" + pool.format("true"),
        "rank_predictions": f"with {_P} select * from predictions",
        "rank_at_each_k": f"with {_P} select target_year, model, k, count(*) n from predictions, (values (3), (10)) v(k) where rank <= k group by all",
        "dedup_first_occurrence": f"with {_L}, f as (select id, min(pos) pos from lines where line <> '' group by id, lower(line)) select id, count(*) n, sum(pos)::bigint positions from f group by id",
        "pairs_next_year": f"with {_Q}, n as (select year, count(*) n from questions where year <= 2020 group by year) select n.year, n.n n_context, t.n n_target from n join n t on t.year = n.year + 1",
        "sample_uniform": f"with {_Q} select id from questions where year < 2023 order by md5('42:' || question_text), question_text, id limit 50",
        "sample_weighted": f"with {_Q}, k as (select id, year, row_number() over (partition by year order by -ln(({_U.format(42, 'question_text')} + 0.5) / 4294967296.0::double) / (greatest(impact_score, 0) + 1e-6), question_text, id) rk from questions) select id, year from k where rk <= 5",
        "sample_split": f"with {_Q}, k as (select id, row_number() over (order by md5('42:' || question_text || ':' || id), id) rk, count(*) over () m from questions) select id, case when m >= 10 and rk <= least(greatest(1, round_even(m * 0.1::double, 0)), m // 2) then 'val' else 'train' end part from k",
        "sample_pairs": f"with {_Q}, rl as (select id real_id, question_text from questions where year = 2020 order by md5('42:' || question_text), question_text, id limit 50), p as (select id, row_number() over (order by id) - 1 place, count(*) over () m from questions where year < 2020) select real_id, id distractor_id from rl join p on place = {_U.format(7, 'question_text')} % m",
        "store_upsert": f"with {_DELTA} select pmid, year from d union all select pmid, year from base where pmid not in (select pmid from d)",
        "store_segment_method": f"with {_S} select pmid, case when segmentation_method like '%+subject' then segmentation_method else coalesce(segmentation_method, 'hybrid') || '+subject' end as method from segments",
    }


ORACLE = _oracle()
