"""Tables that several queries start from, in Spark and as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import n_words
from quillspark.operators.impact import citation_rate, label_critical
from quillspark.sources.tables import articles, citations, spread, table

REF_YEAR = 2026

#: Lines on which rules apply that the synthetic texts never trigger.
SAMPLES = (
    "1. J Neurosci. 2019 Mar 5;39(10):1-12.", "10.1038/s41586-020-0001", "Epub 2020 Jan 3.", "see also doi:", "PMID: 123456",
    "Smith JA(1), Müller B(2), O'Neil C(3).", "(1)Department of Neurology, University of Somewhere.", "Author information:",
    "Lee HS", "Kim JK(1)(2)", "Paris, France.", "USA", "75013 Paris, France", "contact: someone@mail.example.org", "Electronic address: x@y.org",
    "Department of Psychiatry, Medical Faculty", "We studied patients at the University hospital and found significant results",
    "Comment in Nature: a long enough note", "(#)Contributed equally to this work as first authors", "Collaborators: Smith A, Jones B, Brown C",
    "Update of bioRxiv: earlier version of this paper", "names Alpha(1)(2) and Beta(3)(4) with many (indexes)",
    "1. Role of hippocampal plasticity in spatial memory and attention during aging?", "- Whether cortical microglia shape synaptic pruning in early development??",
    "TASK: propose exactly ten lines", "Propose 10 research directions for next year, each on one line", "Year 2021: themes known so far in the field",
    "[2019] Cortical control of motor learning in adult mice and humans", "doi: 10.1000/xyz some direction with an identifier in it", "PMID: 42 some direction text that is long",
    "###  ## numbered nonsense of many signs", "1.1.1. degenerate list of numbers", "12.34 56 78. 90 11 22 33", "Role of cerebellar nuclei in top-down motor cortex control",
    "Here we found that " + "many words go on " * 9, "Short text here", "one two three four five six seven", "word " * 27 + "end", "",
    "We aimed to examine the role of dopamine in flexible decision making, using optogenetics in mice",
    "The aim of this study was to assess whether sleep improves memory consolidation in older adults; with EEG",
    "Research direction: Study of thalamic gating of attention showing that neurons differ and", "Investigating the effect of stress on GABA signaling in the",
    "Mechanisms of motor cortex plasticity after stroke (third repeat)", "\"Discovery of a circuit for attention\"", "OBJECTIVE: to test", "we show significantly increased memory?",
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, line): the documents' lines, and the samples under negative ids."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    samples = spark.createDataFrame([(-1 - k, 0, s) for k, s in enumerate(SAMPLES)], "id long, pos int, line string")
    return docs.union(samples)


def topic_line(text):
    """The first line of 8 to 25 words, or null."""
    return F.get(F.filter(F.split(text, "\n"), lambda line: n_words(line).between(8, 25)), F.lit(0))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pmid, question_text, year, impact_score, is_critical) of the articles that have a topic line."""
    scored = articles(spark, sf_dir).select("pmid", "year", topic_line(F.col("abstract")).alias("question_text"))
    rated = scored.join(citations(spark, sf_dir), "pmid", "left").withColumn("rate", citation_rate(F.col("citation_count"), F.col("year"), REF_YEAR))
    labelled = label_critical(rated).filter("question_text is not null")
    return labelled.select(F.col("pmid").cast("long").alias("id"), "pmid", "question_text", "year", F.col("rate").alias("impact_score"), "is_critical")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, question, qc_score, segmentation_method): topic lines, scored where the documents are labelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", topic_line(F.col("text")).alias("question")).filter("question is not null")
    qc = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2)
    method = F.when(F.col("doc_id") % 3 == 0, "llm").when(F.col("doc_id") % 3 == 1, "rules+subject")
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select(F.col("doc_id").cast("string").alias("pmid"), "question", qc.alias("qc_score"), method.alias("segmentation_method"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_year, model, rank, text): the benchmark's topic lines, dealt to three models and years."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    fit = items.filter(n_words(F.col("text")).between(8, 25))
    model = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("item_id") % 3 + 1).cast("int"))
    dealt = fit.select((2023 + F.floor(F.col("item_id") / 3) % 3).cast("int").alias("target_year"), model.alias("model"), "item_id", "pos", "text")
    from quillspark.operators.ranking import ranked

    return ranked(dealt, ["target_year", "model"], [F.col("item_id"), F.col("pos")]).drop("item_id", "pos")


def _values() -> str:
    return ", ".join(f"({-1 - k}, 0, '{s.replace(chr(39), chr(39) * 2)}')" for k, s in enumerate(SAMPLES))


N_WORDS = r"len(regexp_extract_all(coalesce({0}, ''), '\S+'))"
TOPIC = f"list_filter(string_split(text, chr(10)), lambda x: {N_WORDS.format('x')} between 8 and 25)[1]"
LINES_SQL = f"""
dl as (select doc_id as id, string_split(text, chr(10)) as ls from documents),
lines as (select id, (generate_subscripts(ls, 1) - 1)::int as pos, unnest(ls) as line from dl
          union all select id::bigint, pos, line from (values {_values()}) v(id, pos, line))
"""
QUESTIONS_SQL = f"""
a as (select cast(doc_id as varchar) pmid, cast(2000 + doc_id % 27 as int) as year, {TOPIC} as question_text from documents),
c as (select cast(l_partkey as varchar) pmid, count(*) citation_count from lineitem where l_partkey % 3 <> 0 group by l_partkey),
r as (select a.pmid, a.year, question_text, coalesce(citation_count, 0) / cast(greatest(1, {REF_YEAR} - a.year) as double) rate
      from a left join c on a.pmid = c.pmid),
w as (select *, row_number() over (partition by year order by rate, pmid) rn, count(*) over (partition by year) n from r),
t as (select year, rate thr from w where rn = greatest(cast(floor(0.9::double * n) as bigint) - 1, 0) + 1),
questions as (select w.pmid::bigint as id, w.pmid, question_text, w.year, w.rate as impact_score,
                     cast(case when w.rate >= t.thr and w.rate > 0 then 1 else 0 end as int) is_critical
              from w join t on w.year = t.year where question_text is not null)
"""
SEGMENTS_SQL = f"""
s0 as (select doc_id, {TOPIC} as question from documents),
segments as (select cast(s0.doc_id as varchar) pmid, question, case quality when 1 then 0.9::double when 0 then 0.2::double end qc_score,
                    case s0.doc_id % 3 when 0 then 'llm' when 1 then 'rules+subject' end segmentation_method
             from s0 left join labels l on s0.doc_id = l.doc_id where question is not null)
"""
PREDICTIONS_SQL = f"""
b0 as (select item_id, string_split(text, chr(10)) ls from benchmark),
b1 as (select item_id, generate_subscripts(ls, 1) pos, unnest(ls) as text from b0),
predictions as (select cast(2023 + (item_id // 3) % 3 as int) target_year, ['a', 'b', 'c'][item_id % 3 + 1] model,
                       row_number() over (partition by (item_id // 3) % 3, item_id % 3 order by item_id, pos)::int rank, text
                from b1 where {N_WORDS.format('text')} between 8 and 25)
"""
