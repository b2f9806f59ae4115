"""What a store holds after its writes: each query goes through a store of its own and reads the table back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillspark.functions import directions as D
from quillspark.functions.models import EchoGenerator, Loaded
from quillspark.operators.drivers import impact_table, index_counts
from quillspark.operators.ranking import sampled
from quillspark.operators.store import Store
from quillspark.plans import common as C
from quillspark.plans import sqltext as Q
from quillspark.plans.streams import shared_folder
from quillspark.sources.collect import skipped, uncited, worklist
from quillspark.sources.tables import articles, citations, table
from quillspark.streaming import ingest

NOW = datetime(2026, 1, 1)


def _store(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store")


def store_citations(spark, sf_dir):
    """Citations after an upsert of every fifth with a new count, and of some that are new."""
    store, cited = _store(spark), citations(spark, sf_dir)
    store.write("citations", cited.withColumn("source", F.lit("first")))
    fifth = F.col("pmid").cast("long") % 5 == 0
    more = cited.filter(fifth).select("pmid", (F.col("citation_count") + 1000).alias("citation_count"), F.lit("second").alias("source"))
    new = cited.filter(F.col("pmid").cast("long") % 100 == 1).select(F.concat(F.lit("n"), "pmid").alias("pmid"), "citation_count", F.lit("new").alias("source"))
    store.upsert("citations", more.union(new), ["pmid"], [F.desc("citation_count")])
    return store.read("citations").select("pmid", "citation_count", "source")


def store_segments(spark, sf_dir):
    """Segments after an upsert of those that score low."""
    store = _store(spark)
    store.write("article_segments", C.segments(spark, sf_dir))
    low = store.read("article_segments").filter("qc_score < 0.5").select("pmid", F.lit("drawn anew").alias("question"), F.lit(0.7).alias("qc_score"), F.lit("llm").alias("segmentation_method"))
    store.upsert("article_segments", low, ["pmid"], [F.col("question")])
    return store.read("article_segments").select("pmid", "question", "qc_score", "segmentation_method")


def store_impact(spark, sf_dir):
    """Impact and critical marks of all articles as stored."""
    store = _store(spark)
    store.write("article_impact", impact_table(articles(spark, sf_dir), citations(spark, sf_dir), C.REF_YEAR).withColumnRenamed("rate", "impact_score"))
    return store.read("article_impact").select("pmid", F.round("impact_score", 6).alias("impact_score"), "is_critical")


def store_predictions(spark, sf_dir):
    """Predictions after one model's lists of two years were replaced by shorter ones."""
    store = _store(spark)
    rows = C.predictions(spark, sf_dir).select("target_year", "model", "rank", F.col("text").alias("question_predicted"), F.lit("r").alias("run_id"))
    store.replace_predictions(rows)
    again = rows.filter("model = 'a' and target_year < 2025 and rank <= 3").withColumn("question_predicted", F.concat("question_predicted", F.lit(" again")))
    store.replace_predictions(again)
    return store.read("predictions").select("target_year", "model", "rank", "question_predicted")


def store_evaluations(spark, sf_dir):
    """Counts of metrics after three runs were appended."""
    store = _store(spark)
    years = C.questions(spark, sf_dir).groupBy(F.col("year").alias("target_year")).agg(F.count("*").cast("double").alias("value"))
    for k in (10, 50, 100):
        store.append("evaluations", years.select("target_year", F.lit("m").alias("model"), F.lit("n").alias("metric"), F.lit(k).alias("k"), (F.col("value") / k).alias("value"), F.lit(f"run{k}").alias("run_id")))
    return store.read("evaluations").groupBy("run_id", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def store_cleared(spark, sf_dir):
    """How many rows are left when derived tables are emptied."""
    store = _store(spark)
    store.upsert_articles(articles(spark, sf_dir), NOW)
    store.write("citations", citations(spark, sf_dir))
    store.write("questions", C.questions(spark, sf_dir))
    store.write("article_segments", C.segments(spark, sf_dir))
    store.clear_derived()
    counts = index_counts(store)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


def resume_embedding(spark, sf_dir):
    """Questions that have no vector yet, where every third has none."""
    vector = F.when(F.col("id") % 3 != 0, F.array(F.lit(1.0).cast("float")))
    return C.questions(spark, sf_dir).withColumn("embedding", vector).filter("embedding is null").select("id", "question_text")


def resume_collecting(spark, sf_dir):
    """The first ids, of those that customers ask for, that aren't stored as articles."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pmid"))
    return worklist(asked, articles(spark, sf_dir), 100)


def resume_citations(spark, sf_dir):
    return uncited(articles(spark, sf_dir), citations(spark, sf_dir)).select("pmid", "year")


def skipped_ids(spark, sf_dir):
    """Ids that were asked for and are no article with a topic line."""
    asked = articles(spark, sf_dir).select("pmid")
    return skipped(asked, C.questions(spark, sf_dir).select("pmid"))


def pred_extraction_score(spark, sf_dir):
    """Scores of lines as extracted directions, with classes dealt by their ids."""
    label = F.element_at(F.array(F.lit("subject"), F.lit("noise"), F.lit("methods")), (F.abs("id") % 3 + 1).cast("int"))
    found = C.lines(spark, sf_dir).filter("line <> ''")
    return found.select("id", "pos", F.round(D.extraction_score(F.col("line"), label, F.lit(0.4)), 6).alias("score"))


def pred_weighted_impact(spark, sf_dir):
    """Impact weighted by a segment's score."""
    joined = C.segments(spark, sf_dir).join(C.questions(spark, sf_dir).select("pmid", "impact_score"), "pmid")
    return joined.select("pmid", F.round(D.weighted_impact(F.col("impact_score"), F.coalesce("qc_score", F.lit(0.0))), 6).alias("weighted"))


def sample_per_year(spark, sf_dir):
    """Ten questions of the years before each of three years, by a seed that the year is added to."""
    questions = C.questions(spark, sf_dir).withColumn("key", F.concat_ws(":", "question_text", "id"))
    parts = [sampled(questions.filter(F.col("year") < year), 10, 42 + year, "key").select(F.lit(year).alias("target"), "id") for year in (2019, 2020, 2021)]
    return parts[0].union(parts[1]).union(parts[2])


def stream_upserts(spark, sf_dir):
    """Citations counted up from events that come as a stream, upserted batch by batch: each user's last event."""
    store, at = _store(spark), shared_folder(spark)
    events = ingest.event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("pmid"), F.col("event_id").alias("citation_count"), F.col("event_type").alias("source"))
    ingest.run_upserts(events, store, "citations", ["pmid"], [F.desc("citation_count")], f"{at}/checkpoint")
    return store.read("citations").select("pmid", "citation_count", "source")


def stream_directions(spark, sf_dir):
    """Directions of articles that come as a stream, drawn once each by the stand-in."""
    store, at = _store(spark), shared_folder(spark)
    docs = ingest.table_stream(spark, sf_dir, "documents", "doc_id long, text string")
    arriving = docs.select(F.col("doc_id").cast("string").alias("pmid"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"))
    for _ in range(2):  # the second run has nothing left to do
        ingest.run_directions(arriving, store, Loaded(EchoGenerator), f"{at}/checkpoint")
    return store.read("article_segments").select("pmid", "segmentation_method")


QUERIES = {f.__name__: f for f in (
    store_citations, store_segments, store_impact, store_predictions, store_evaluations, store_cleared, resume_embedding, resume_collecting,
    resume_citations, skipped_ids, pred_extraction_score, pred_weighted_impact, sample_per_year, stream_upserts, stream_directions,
)}


def _oracle() -> dict[str, str]:
    q, s, p, lines = C.QUESTIONS_SQL.strip(), C.SEGMENTS_SQL.strip(), C.PREDICTIONS_SQL.strip(), C.LINES_SQL.strip()
    cited = "cits as (select cast(l_partkey as varchar) pmid, count(*) citation_count from lineitem where l_partkey % 3 <> 0 group by 1)"
    score = "least(1.0::double, greatest({0}, 0.55::double) + 0.15::double * 0.4)"
    heuristic = Q.subjectness("line", "ns")
    return {
        "store_citations": f"with {cited} select pmid, citation_count + case when pmid::bigint % 5 = 0 then 1000 else 0 end citation_count, case when pmid::bigint % 5 = 0 then 'second' else 'first' end source from cits union all select 'n' || pmid, citation_count, 'new' from cits where pmid::bigint % 100 = 1",
        "store_segments": f"with {s} select pmid, case when qc_score < 0.5 then 'drawn anew' else question end question, case when qc_score < 0.5 then 0.7::double else qc_score end qc_score, case when qc_score < 0.5 then 'llm' else segmentation_method end segmentation_method from segments",
        "store_impact": f"with {q} select w.pmid, round(w.rate, 6) impact_score, case when w.rate >= t.thr and w.rate > 0 then 1 else 0 end::int is_critical from w join t on w.year = t.year where w.year between 2000 and 2027",
        "store_predictions": f"with {p} select target_year, model, rank, text question_predicted from predictions where not (model = 'a' and target_year < 2025) union all select target_year, model, rank, text || ' again' from predictions where model = 'a' and target_year < 2025 and rank <= 3",
        "store_evaluations": f"with {q}, n as (select year, count(*)::double n from questions group by year) select 'run' || k run_id, k::int k, count(*) n, round(sum(n / k), 4) as value from n, (values (10), (50), (100)) v(k) group by k",
        "store_cleared": f"with {cited} select (select count(*) from documents) articles, (select count(*) from documents where doc_id::varchar in (select pmid from cits)) cited, 0::bigint segmented, 0::bigint questions, 0::bigint embedded",
        "resume_embedding": f"with {q} select id, question_text from questions where id % 3 = 0",
        "resume_collecting": "select c_custkey::varchar pmid from customer where c_custkey not in (select doc_id from documents) order by pmid limit 100",
        "resume_citations": f"with {cited} select doc_id::varchar pmid, cast(2000 + doc_id % 27 as int) as year from documents where doc_id::varchar not in (select pmid from cits)",
        "skipped_ids": f"with {q} select doc_id::varchar pmid from documents where doc_id::varchar not in (select pmid from questions)",
        "pred_extraction_score": f"with {lines}, n as (select id, pos, line, {Q.normal_space('line')} ns from lines where line <> ''), h as (select id, pos, abs(id) % 3 c, {heuristic} h from n) select id, pos, round(greatest(0.35::double, case c when 1 then greatest(h, 0.55::double) * 0.5 when 2 then greatest(h, 0.55::double) * 0.7 else {score.format('h')} end), 6) score from h",
        "pred_weighted_impact": f"with {q}, {s} select s.pmid, round(impact_score * greatest(0.15::double, coalesce(qc_score, 0)), 6) weighted from segments s join questions q on s.pmid = q.pmid",
        "sample_per_year": f"with {q}, y as (select target::int target, id, row_number() over (partition by target order by md5((42 + target) || ':' || question_text || ':' || id)) place from questions, (values (2019), (2020), (2021)) v(target) where year < target) select target, id from y where place <= 10",
        "stream_upserts": "select user_id::varchar pmid, max(event_id) citation_count, arg_max(event_type, event_id) source from events group by user_id",
        "stream_directions": "select doc_id::varchar pmid, 'llm' segmentation_method from documents",
    }


ORACLE = _oracle()
