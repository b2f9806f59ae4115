"""Queries around language models: prompts, pairs, perplexity with the stand-in scorer, audits, generation, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.models import BigramScorer, HashingEncoder, compressed_length, encoded, passage
from quillspark.functions import patterns as P
from quillspark.functions.directions import direction_key
from quillspark.operators import forecast as G
from quillspark.operators.ranking import draw_key, sampled
from quillspark.operators.similarity import kept_apart
from quillspark.plans import common as C
from quillspark.plans import relational
from quillspark.plans import sqltext as Q
from quillspark.sources import export
from quillspark.sources.tables import spread, table


def prompt_extraction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prompt = G.extraction_prompt(F.substring_index("text", "\n", 1), F.col("text"))
    return docs.select("doc_id", F.length(prompt).alias("n_chars"), F.md5(prompt.cast("binary")).alias("prompt"))


def prompt_contexts(spark, sf_dir):
    """The context of every year, and the prompt to continue it."""
    questions = C.questions(spark, sf_dir)
    found = G.contexts(questions, questions.select("year"), 30)
    prompt = G.continuation_prompt(F.col("year"), F.col("year") + 1, F.col("context"))
    return found.select("year", F.md5(prompt.cast("binary")).alias("prompt"))


def prompt_instruct(spark, sf_dir):
    questions = C.questions(spark, sf_dir)
    found = G.contexts(questions, questions.select("year"), 3)
    prompt = G.instruct_prompt(F.col("year"), F.col("year") + 1, F.col("context"), F.array(F.lit("one"), F.lit("two")))
    return found.select("year", prompt.alias("prompt"))


def pairs_training(spark, sf_dir):
    pairs = G.training_pairs(C.questions(spark, sf_dir), 2020, most=40)
    return pairs.select("target_year", F.md5(F.col("prompt").cast("binary")).alias("prompt"), "completion")


def pairs_error_examples(spark, sf_dir):
    """Ground truth of 2020 that no prediction has word for word."""
    questions = C.questions(spark, sf_dir)
    missed = questions.join(C.predictions(spark, sf_dir).select(F.col("text").alias("question_text")), "question_text", "left_anti")
    return G.error_examples(questions, missed, 2020)


def _scorer(spark, sf_dir):
    return BigramScorer.fitted(C.questions(spark, sf_dir).filter("year < 2020"), "question_text")


def lm_perplexity(spark, sf_dir):
    """Perplexity of each question from 2020 on under the stand-in scorer of those before."""
    found = _scorer(spark, sf_dir).perplexities(C.questions(spark, sf_dir).filter("year >= 2020"), "id", "question_text")
    return found.select("id", F.round("ppl", 4).alias("ppl"))


def lm_discrimination(spark, sf_dir):
    """How often a question of 2020 is less surprising than one of the years before; equal ones count as wrong."""
    questions = C.questions(spark, sf_dir)
    from quillspark.plans.relational import sample_pairs

    texts = questions.withColumn("question_text", passage(F.col("question_text")))
    ppl = _scorer(spark, sf_dir).perplexities(texts.filter("year <= 2020"), "id", "question_text")
    pairs = sample_pairs(spark, sf_dir)
    joined = pairs.join(ppl.select(F.col("id").alias("real_id"), F.col("ppl").alias("a")), "real_id").join(ppl.select(F.col("id").alias("distractor_id"), F.col("ppl").alias("b")), "distractor_id")
    return joined.agg(F.round(F.avg((F.col("a") < F.col("b")).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.abs(F.col("b") - F.col("a"))), 3).alias("confidence"), F.count("*").alias("n_pairs"))


def lm_compression_ratio(spark, sf_dir):
    """Compressed length over perplexity: mean, median and the share above the 90th percentile of a sample of the past."""
    questions, scorer = C.questions(spark, sf_dir), _scorer(spark, sf_dir)
    ratio = lambda df: df.withColumn("z", compressed_length("question_text")).join(scorer.perplexities(df, "id", "question_text"), "id").select((F.col("z") / F.col("ppl")).alias("r"))
    line = ratio(sampled(questions.filter("year < 2020"), 200, 42, "question_text")).agg(F.percentile("r", F.lit(0.9)).alias("high"))
    found = ratio(questions.filter("year = 2020")).crossJoin(line)  # one row
    return found.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.median("r").alias("median"), F.avg((F.col("r") >= F.col("high")).cast("double")).alias("high_rate"))


def embed_questions(spark, sf_dir):
    """Questions with stand-in vectors; digests of the vectors."""
    found = encoded(C.questions(spark, sf_dir), "question_text", HashingEncoder())
    return found.select("id", F.size("embedding").alias("size"), F.md5(F.to_json(F.transform("embedding", lambda x: F.round(x, 4))).cast("binary")).alias("digest"))


def filter_near_duplicates(spark, sf_dir):
    """Predictions that are no near-duplicate of one ranked before them."""
    preds = encoded(C.predictions(spark, sf_dir).withColumn("key", direction_key(F.col("text"))), "text", HashingEncoder())
    return kept_apart(preds, ["target_year", "model"], "rank", "text", "key", "embedding").select("target_year", "model", "rank", "text")


def parse_sections(spark, sf_dir):
    """Sections of documents whose second and third lines are given headers."""
    lines = F.split("text", "\n")
    text = F.concat_ws("\n", F.get(lines, F.lit(0)), F.concat(F.lit("METHODS: "), F.get(lines, F.lit(1))), F.concat(F.lit("RESULTS: "), F.get(lines, F.lit(2))), F.slice(lines, F.lit(4), F.size(lines)))
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", export.sections(text).alias("s"))
    return found.select("doc_id", F.size("s").alias("n"), F.length(export.results_text(F.col("s"))).alias("n_results"))


def parse_clean(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.length(export.cleaned_abstract("text", F.substring_index("text", "\n", 1))).alias("n_chars"))


def parse_export(spark, sf_dir):
    """Articles from an export made of the documents: a citation line, title, authors, abstract and ids."""
    block = F.concat(F.col("doc_id"), F.lit(". J Test. "), 2000 + F.col("doc_id") % 27, F.lit(" Mar 5;1(2):3-4.\n\nA title of article "), F.col("doc_id"),
                     F.lit(".\n\nSmith JA(1), Lee B(2).\n\nAuthor information:\n(1)Department of Tests, USA.\n\n"), F.col("text"), F.lit("\n\nCopyright 2020\nDOI: 10.1/"), F.col("doc_id"), F.lit("\nPMID: "), F.col("doc_id"))
    exports = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(block.alias("value"))
    found = export.parsed(exports, C.REF_YEAR)
    return found.select("pmid", "year", "doi", "title", F.length("abstract").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    prompt_extraction, prompt_contexts, prompt_instruct, pairs_training, pairs_error_examples, lm_perplexity, lm_discrimination, lm_compression_ratio,
    embed_questions, filter_near_duplicates, parse_sections, parse_clean, parse_export,
)}

_CTX = """
yr as (select distinct year from qs), sp as (select yr.year w, q.* from yr join qs q on q.year between yr.year - 5 and yr.year),
pl as (select *, row_number() over (partition by w order by coalesce(impact_score, 0) desc, year desc, question_text, id) place from sp),
cx as (select w, string_agg(trim(question_text)[1:280], chr(10) order by place) context from pl where place <= {0} group by w)
"""


def _oracle() -> dict[str, str]:
    q = C.QUESTIONS_SQL.strip()
    every = f"{q}, qs as (select * from questions), "
    past = f"{q}, qs as (select * from questions where year <= 2020), "
    cont = "'Year ' || w || ':' || chr(10) || case when context <> '' then context || chr(10) else '' end || 'Year ' || (w + 1) || ':' || chr(10)"
    s = lambda text: "'" + text.replace("'", "''") + "'"
    before, rest = G.TOPIC_PROMPT.split("{title}")
    between, after = rest.split("{abstract}")
    given = lambda text: s(text).replace("{context}", "' || w || '").replace("{target}", "' || (w + 1) || '")
    start, themes, rules, through, avoid, ask = map(given, G.INSTRUCT)
    instruct = f"{start} || {themes} || {rules} || {through} || context || chr(10) || {avoid} || '- one' || chr(10) || '- two' || chr(10) || {ask}"
    cap = f"case when length(text) > 3500 then {Q.cut('text[1:3497]', r'\s+$')} || '...' else text end"
    prompt = f"{s(before)} || coalesce(nullif(string_split(text, chr(10))[1], ''), 'Untitled') || {s(between)} || {cap} || {s(after)}"
    surprise = lambda asked, text: f"""{q}, tr as (select list_prepend('<s>', {Q.tokens('question_text')}) t from questions where year < 2020), u1 as (select unnest(t) word from tr), uni as (select word, count(*) n1 from u1 group by word),
        b1 as (select unnest(list_zip(t[1:-2], t[2:])) p from tr where len(t) > 1), bi as (select p[1] a, p[2] b, count(*) n2 from b1 group by all),
        st as (select sum(n1) tot, count(*) voc from uni where word <> '<s>'), te as (select id, list_prepend('<s>', {Q.tokens(text)}) t from questions where {asked}),
        e as (select id, unnest(list_zip(t[1:-2], t[2:])) p from te where len(t) > 1),
        l as (select id, ln(0.7::double * coalesce(n2 / ub.n1::double, 0) + (1 - 0.7::double) * ((coalesce(uw.n1, 0) + 1.0::double) / (tot + voc + 1.0::double))) l
              from e left join bi on bi.a = p[1] and bi.b = p[2] left join uni uw on uw.word = p[2] left join uni ub on ub.word = p[1], st)"""  # noqa: E731
    pairs = "rl as" + relational.ORACLE["sample_pairs"].split(", rl as", 1)[1]
    ppl = "pp as (select id, exp(-avg(l)) ppl from l group by id)"
    return {
        "prompt_extraction": f"select doc_id, length({prompt})::int n_chars, md5({prompt}) prompt from documents",
        "prompt_contexts": f"with {every}{_CTX.format(30)} select w as year, md5({cont}) prompt from cx",
        "prompt_instruct": f"with {every}{_CTX.format(3)} select w as year, {instruct} prompt from cx",
        "pairs_training": f"with {past}{_CTX.format(30)}, k as (select *, row_number() over (partition by year order by coalesce(impact_score, 0) desc, question_text, id) rk, count(*) over (partition by year) m from qs) select k.year target_year, md5({cont}) prompt, question_text[1:400] completion from k join cx on cx.w = k.year - 1 where rk <= least(40, greatest(1, floor(m * 0.7::double)))",
        "pairs_error_examples": f"with {q}, {C.PREDICTIONS_SQL.strip()}, y as (select *, max(is_critical) over () any_critical from questions where year = 2020) select id, question_text[1:400] completion from y where (is_critical = 1 or any_critical = 0) and question_text not in (select text from predictions) order by id limit 50",
        "lm_perplexity": f"with {surprise('year >= 2020', 'question_text')} select id, round(exp(-avg(l)), 4) ppl from l group by id",
        "lm_discrimination": f"""with {surprise('year <= 2020', "'Research direction: ' || trim(question_text)")}, {ppl}, sm as (with {q}, {pairs})
            select round(avg((a.ppl < b.ppl)::int::double), 6) accuracy, round(avg(abs(b.ppl - a.ppl)), 3) confidence, count(*) n_pairs from sm join pp a on a.id = real_id join pp b on b.id = distractor_id""",
        "parse_sections": f"""with t as (select doc_id, string_split(text, chr(10)) ls from documents),
            g as (select doc_id, array_to_string(list_concat([ls[1]], case when len(ls) > 1 then ['METHODS: ' || ls[2]] else [] end, case when len(ls) > 2 then ['RESULTS: ' || ls[3]] else [] end, ls[4:]), chr(10)) text from t),
            p as (select doc_id, text, {Q.section_pieces('text')} ps from g),
            u as (select doc_id, unnest(ps) piece, generate_subscripts(ps, 1) place, len(ps) n from p where {Q.has('text', r'[^\s]')}),
            h as (select *, {Q.header_of('piece')} head from u),
            c as (select doc_id, place, case when n = 1 and head = '' then {Q.stripped('piece')} when head = '' then {Q.normal_space('piece')} else {Q.polished(Q.normal_space(Q.after_header('piece')))} end content, head, {Q.header_name('head')} as name, n from h),
            b as (select *, {Q.header_bucket('name')} bucket from c),
            k as (select * from b where content <> '' and case when head = '' then n = 1 or not {Q.is_metadata('content')} else bucket is not null end)
            select d.doc_id, count(place)::int n, length(coalesce(string_agg(content, ' ' order by place) filter (bucket = 'results' and head <> ''), ''))::int n_results from documents d left join k on d.doc_id = k.doc_id group by d.doc_id""",
        "parse_clean": f"with tt as (select doc_id as id, string_split(text, chr(10))[1] as title, text from documents where text is not null), {Q.cleaned('tt')} select d.doc_id, coalesce(length(cleaned), 0)::int n_chars from documents d left join cleaned on d.doc_id = cleaned.id",
        # The title ends before the authors' line, so the body starts in the documents' text or at the line after it.
        "parse_export": f"""with ln as (select doc_id, string_split(text, chr(10)) ls from documents), l as (select doc_id, unnest(ls) raw, generate_subscripts(ls, 1) i from ln), s as (select *, {Q.stripped('raw')} s from l),
            f as (select *, {Q.has('s', P.LEGAL_START)} legal, ({Q.has('s', P.LEGAL_START)} or starts_with(s, 'PMID:') or starts_with(s, 'DOI:') or not (s = '' or {Q.has('s', P.AUTHOR_INFO)} or {Q.is_metadata('s')} or ({Q.is_citation('s')} and not {Q.is_header('s')}))) opens from s),
            b as (select doc_id, min(i) filter (opens) begins from f group by doc_id),
            e as (select f.*, begins from f join b on f.doc_id = b.doc_id where i >= begins),
            z as (select *, min(i) filter (starts_with(s, 'Copyright') or starts_with(s, 'Conflict of interest')) over (partition by doc_id) ends from e),
            tt as (select doc_id as id, 'A title of article ' || doc_id || '.' title, {Q.stripped("string_agg(raw, chr(10) order by i)")} text from z where (ends is null or i < ends) and not (starts_with(s, 'PMID:') or starts_with(s, 'DOI:') or starts_with(s, 'PMCID:')) group by doc_id),
            {Q.cleaned('tt')} select cast(id as varchar) pmid, cast(2000 + id % 27 as int) as year, '10.1/' || id doi, 'A title of article ' || id || '.' title, length(cleaned)::int n_chars from cleaned where cleaned <> ''""",
    }


ORACLE = _oracle()
