"""Text rules over lines of documents and of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import directions as D
from quillspark.functions import lines as L
from quillspark.functions import patterns as P
from quillspark.functions import text as X
from quillspark.operators.blocklist import copies
from quillspark.operators.filters import audited, compliance, kept_directions
from quillspark.plans import common as C
from quillspark.plans import sqltext as Q
from quillspark.sources.tables import table




def _lines(spark, sf_dir):
    return C.lines(spark, sf_dir)


def text_tokens(spark, sf_dir):
    """Tokens and distinct three-token runs of each line."""
    found = _lines(spark, sf_dir).select("id", "pos", X.tokens(F.col("line")).alias("t"), X.trigrams(F.col("line")).alias("g"))
    return found.select("id", "pos", F.size("t").alias("n_tokens"), F.array_join(F.slice("t", 1, 3), " ").alias("head"), F.size("g").alias("n_grams"), F.size(F.array_distinct("g")).alias("distinct_grams"))


def text_word_tools(spark, sf_dir):
    """Cuts and keys of lines: first words, verbatim key, cap."""
    return _lines(spark, sf_dir).select("id", "pos", X.first_words(F.col("line"), 12).alias("first"), X.verbatim_key(F.col("line")).alias("key"), X.capped(F.col("line"), 60).alias("capped"), X.normal_space(F.col("line")).alias("plain"))


def text_citation_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", L.is_citation(F.col("line")).alias("citation"))


def text_metadata_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", L.is_metadata(F.col("line")).alias("metadata"))


def text_junk_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", L.is_junk(F.col("line")).alias("junk"))


def text_polish(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", L.polished(F.col("line")).alias("polished"))


def text_headers(spark, sf_dir):
    """Canonical names and buckets of words that may be section headers."""
    heads = ["Background:", "objectives", "AIM", "methods", " Results :", "expected  results", "Conclusion", "SIGNIFICANCE", "findings", "Purpose", "other"]
    df = spark.createDataFrame([(h,) for h in heads], "header string")
    name = L.header_name(F.col("header"))
    return df.select("header", name.alias("name"), L.header_bucket(name).alias("bucket"))


def text_without_title(spark, sf_dir):
    """Articles without a first line that repeats the title, with a title that goes on a little."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(L.without_title(F.col("text"), F.concat(F.substring_index("text", "\n", 1), F.lit("."))).cast("binary")).alias("rest"))


def text_inferred_year(spark, sf_dir):
    blocks = F.concat(F.col("line"), F.lit(" "), F.element_at(F.array(F.lit("2020 Mar 3"), F.lit("May. 2019"), F.lit("eCollection 2015"), F.lit("in 2007"), F.lit("1999")), (F.abs("id") % 5 + 1).cast("int")))
    return _lines(spark, sf_dir).select("id", "pos", L.inferred_year(blocks, 2026).alias("year"))


def pred_bare_and_key(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", D.bare(F.col("line")).alias("bare"), D.direction_key(F.col("line")).alias("key"))


def pred_rejection_reason(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", D.rejection(F.col("line")).alias("reason"))


def pred_leak(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", D.is_leak(F.col("line")).alias("leak"))


def pred_clean_truth(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", D.is_clean_truth(F.col("line")).alias("clean"))


def pred_clamped(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", D.clamped(F.col("line"), 10).alias("clamped"))


def pred_span(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", D.compressed_span(F.col("line")).alias("span"))


def pred_subjectness(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", F.round(D.subjectness(F.col("line")), 6).alias("score"))


def pred_polished_direction(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", D.polished_direction(F.col("line")).alias("topic"), D.polished_direction(F.col("line"), "precise").alias("specific"))


def pred_parsed_direction(spark, sf_dir):
    """What an assistant's answers say as one direction."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", D.parsed_direction(F.col("text")).alias("direction"))


def pred_diagnosis(spark, sf_dir):
    found = _lines(spark, sf_dir).select("id", "pos", D.diagnosed(F.col("line")).alias("d"))
    return found.select("id", "pos", "d.text", "d.reason")


def pred_subject_resolution(spark, sf_dir):
    """The text and score that each stored draft goes on with, and its weighted impact."""
    found = C.segments(spark, sf_dir).withColumn("r", D.resolved_subject(F.col("question"), F.lit(None).cast("string"), F.col("qc_score"), F.col("segmentation_method")))
    return found.select("pmid", F.col("r.text").alias("subject"), F.round("r.score", 6).alias("score"), F.round(D.weighted_impact(F.lit(2.0), F.col("r.score")), 6).alias("weighted"))


def list_generated(spark, sf_dir):
    """The directions in an assistant's answers, line by line."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", F.posexplode(D.generated_list(F.col("text"))).alias("pos", "direction"))


def filter_kept_directions(spark, sf_dir):
    """Lines that pass all rules, the first of equal ones in each document."""
    return kept_directions(_lines(spark, sf_dir), ["id"], "line", "pos").select("id", "pos", "direction")


def filter_rejection_counts(spark, sf_dir):
    return audited(_lines(spark, sf_dir), ["id"], "line", "pos").groupBy("reason").agg(F.count("*").alias("n"))


def filter_compliance(spark, sf_dir):
    """How well the predictions of each model and year keep to the format."""
    found = compliance(C.predictions(spark, sf_dir), ["target_year", "model"], "text")
    return found.select("target_year", "model", "n", *[F.round(c, 6).alias(c) for c in found.columns if c.startswith(("frac", "mean"))])


def filter_blocklist_copies(spark, sf_dir):
    """Lines that copy one of the questions before 2012, wholly or from their starts on."""
    blocked = C.questions(spark, sf_dir).filter("year < 2012").select(F.col("question_text").alias("text"))
    return copies(_lines(spark, sf_dir), "line", blocked, "text").select("id", "pos").distinct()


QUERIES = {f.__name__: f for f in (
    text_tokens, text_word_tools, text_citation_lines, text_metadata_lines, text_junk_lines, text_polish, text_headers, text_without_title,
    text_inferred_year, pred_bare_and_key, pred_rejection_reason, pred_leak, pred_clean_truth, pred_clamped, pred_span, pred_subjectness,
    pred_polished_direction, pred_parsed_direction, pred_diagnosis, pred_subject_resolution, list_generated, filter_kept_directions,
    filter_rejection_counts, filter_compliance, filter_blocklist_copies,
)}


def _oracle() -> dict[str, str]:
    lines = f"with {C.LINES_SQL}"
    bare = f"{lines}, b as (select id, pos, line, {Q.bare('line')} s, {Q.normal_space(Q.bare('line'))} ns from lines)"
    reason = f"{bare}, r as (select id, pos, s, {Q.rejection('s', 'ns')} reason from b)"
    kept = f"{reason}, k as (select *, row_number() over (partition by id, lower(s) order by pos) rn from r where reason is null)"
    turns = "turns as (select conv_id, turn, text from conversations where role = 'assistant')"
    split = r"regexp_split_to_array(text, '\r\n|\r|\n')"
    fit = f"list_filter(list_transform({split}, lambda l: {Q.polished_direction('l')}), lambda s: s <> '' and not {Q.has('s', '(?i)^(?:rules:|note:|what is the main research direction)')} and not {Q.has('s', '^[-\\s]+$')})"
    listed = f"list_filter(list_transform({split}, lambda l: {Q.bare('l')}), lambda s: length(s) >= 15)"
    whole = Q.bare("replace(text, chr(10), ' ')")
    ds = Q.span("line", 8)
    names = " ".join(f"when starts_with(u, '{a}') then '{b}'" for a, b in P.HEADER_STARTS)
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    heads = ", ".join(f"('{h}')" for h in ["Background:", "objectives", "AIM", "methods", " Results :", "expected  results", "Conclusion", "SIGNIFICANCE", "findings", "Purpose", "other"])
    first, ttl = Q.normal_space("string_split(text, chr(10))[1]"), Q.normal_space("string_split(text, chr(10))[1] || '.'")
    rest = Q.stripped("case when contains(text, chr(10)) then text[strpos(text, chr(10)) + 1:] else '' end")
    resolved = f"""
      n as (select *, {Q.stripped("coalesce(question, '')")} d from segments),
      e as (select *, {Q.bare('d')} s, {Q.normal_space(Q.bare('d'))} ns, {Q.n_words('d')} nw, coalesce(qc_score, 0) qc, {Q.span('d')} sp from n),
      f as (select *, {Q.rejection('s', 'ns')} reason, {Q.normal_space('sp')} nsp, (qc_score is null or qc < 0.35 or nw > 30 or nw < 5) anew,
                   coalesce(contains(lower(segmentation_method), 'llm'), false) and d <> '' by_model from e),
      g as (select *, {Q.subjectness('sp', 'nsp')} sc from f),
      h as (select pmid, case when by_model and reason is null then d when by_model then null when not anew and d <> '' then d when sp is null or sc < 0.35 then null else sp end subject,
                   case when by_model and reason is null then greatest(qc, 0.35) when by_model then qc when not anew and d <> '' then qc when sp is null then qc else sc end score from g)"""
    pred = C.PREDICTIONS_SQL
    blocked = f"{C.QUESTIONS_SQL}, bk as (select distinct {Q.direction_key('question_text')} k from questions where year < 2012)"
    return {
        "text_tokens": f"{lines}, t as (select id, pos, {Q.tokens('line')} t from lines), g as (select *, case when len(t) >= 3 then list_transform(range(1, len(t) - 1), lambda k: array_to_string(t[k:k + 2], ' ')) when len(t) > 0 then [array_to_string(t, ' ')] else [] end g from t) select id, pos, len(t)::int n_tokens, array_to_string(t[1:3], ' ') head, len(g)::int n_grams, len(list_distinct(g))::int distinct_grams from g",
        "text_word_tools": f"{lines} select id, pos, {Q.first_words('line', 12)} \"first\", array_to_string({Q.words('lower(line)')}, ' ') as key, case when length(line) > 60 then {Q.cut('line[1:57]', '\\s+$')} || '...' else line end capped, {Q.normal_space('line')} plain from lines",
        "text_citation_lines": f"{lines} select id, pos, {Q.is_citation('line')} citation from lines",
        "text_metadata_lines": f"{lines}, s as (select id, pos, {Q.stripped('line')} s from lines) select id, pos, {Q.is_metadata('s')} metadata from s",
        "text_junk_lines": f"{lines}, s as (select id, pos, {Q.normal_space('line')} s from lines) select id, pos, {Q.is_junk('s')} junk from s",
        "text_polish": f"{lines} select id, pos, {Q.polished('line')} polished from lines",
        "text_headers": f"with h as (select *, regexp_replace(upper({Q.normal_space('header')}), ':+$', '') u from (values {heads}) v(header)), n as (select header, case {names} else u end as name from h) select header, name, case when name in ({quoted(P.QUESTION_HEADERS)}) then 'question' when name in ({quoted(P.RESULTS_HEADERS)}) then 'results' end bucket from n",
        "text_without_title": f"with t as (select doc_id, text, {first} f, {ttl} t from documents) select doc_id, md5(case when length(t) >= 12 and text <> '' and starts_with(lower(f), lower(t)[1:least(length(t), length(f))]) and length(f) >= length(t) * 0.75 then {rest} else text end) rest from t",
        "text_inferred_year": f"{lines}, b as (select id, pos, line || ' ' || ['2020 Mar 3', 'May. 2019', 'eCollection 2015', 'in 2007', '1999'][abs(id) % 5 + 1] b from lines), y as (select id, pos, nullif(regexp_extract(b, '{P.re2(P.MONTH_YEAR)}', 1), '')::int m, nullif(regexp_extract(b, '{P.re2(P.COLLECTION_YEAR)}', 1), '')::int c, nullif(regexp_extract(b[1:400], '{P.re2(P.CENTURY_YEAR)}', 1), '')::int e from b) select id, pos, coalesce(m, c, case when e between 2000 and 2026 then e end) as year from y",
        "pred_bare_and_key": f"{lines} select id, pos, {Q.bare('line')} bare, {Q.direction_key('line')} as key from lines",
        "pred_rejection_reason": f"{reason} select id, pos, reason from r",
        "pred_leak": f"{bare} select id, pos, (s = '' or lower(s) in ({quoted(P.FEWSHOT)}) or {Q.has('s', P.PROMPT_LEAK)} or {Q.has('s', P.INSTRUCTION)}) leak from b",
        "pred_clean_truth": f"{reason} select r.id, r.pos, ({Q.stripped('line')} <> '' and coalesce(reason not in ({Q.NOISE}), true) and {Q.n_words('line')} <= 40) clean from r join lines l on l.id = r.id and l.pos = r.pos",
        "pred_clamped": f"{lines}, c as (select id, pos, {Q.stripped(Q.cut(Q.bare('line'), P.REPEAT_MARK))} s from lines) select id, pos, case when {Q.n_words('s')} <= 10 then s else {Q.cut(Q.first_words('s', 10), '[.,;: ]+$')} end clamped from c",
        "pred_span": f"{lines} select id, pos, {Q.span('line')} span from lines",
        "pred_subjectness": f"{lines}, s as (select id, pos, line, {Q.normal_space('line')} ns from lines) select id, pos, round({Q.subjectness('line', 'ns')}, 6) score from s",
        "pred_polished_direction": f"{lines} select id, pos, {Q.polished_direction('line')} topic, {Q.polished_direction('line', P.SPECIFIC_PREFIX)} specific from lines",
        "pred_parsed_direction": f"with {turns}, f as (select *, {fit} f from turns) select conv_id, turn, case when {Q.stripped('text')} <> '' then coalesce(f[1], nullif({Q.polished_direction('replace(text, chr(10), chr(32))')}, '')) end direction from f",
        "pred_diagnosis": f"{lines}, d as (select id, pos, line, {ds} sp, {Q.bare('line')} bb from lines), e as (select *, coalesce(sp, bb) best, {Q.bare('coalesce(sp, bb)')} s, {Q.normal_space(Q.bare('coalesce(sp, bb)'))} ns from d) select id, pos, case when {Q.stripped('line')} <> '' and best <> '' then best end as text, case when {Q.stripped('line')} = '' or best = '' then 'empty' else {Q.rejection('s', 'ns')} end reason from e",
        "pred_subject_resolution": f"with {C.SEGMENTS_SQL}, {resolved} select pmid, subject, round(score, 6) score, round(2.0::double * greatest(0.15::double, score), 6) weighted from h",
        "list_generated": f"with {turns}, f as (select *, {listed} f, {whole} w from turns), g as (select conv_id, turn, case when len(f) > 0 then list_filter(f, lambda s, k: list_position(list_transform(f, lambda z: lower(z)), lower(s)) = k) when length(w) >= 15 then [w] else [] end g from f) select conv_id, turn, (generate_subscripts(g, 1) - 1)::int pos, unnest(g) direction from g",
        "filter_kept_directions": f"{kept} select id, pos, s direction from k where rn = 1",
        "filter_rejection_counts": f"{kept}, a as (select reason from r where reason is not null union all select case when rn > 1 then 'duplicate' end from k) select reason, count(*) n from a group by reason",
        "filter_compliance": f"with {pred}, b as (select *, {Q.bare('text')} s, {Q.normal_space(Q.bare('text'))} ns from predictions), r as (select *, {Q.rejection('s', 'ns')} reason, {Q.n_words('s')} nw from b) select target_year, model, count(*) n, "
        + ", ".join(f"round(avg(({test})::int::double), 6) {name}" for name, test in {
            "frac_numbered": Q.has(Q.stripped("text"), r"^\d+[.)]\s+\S"), "frac_valid": "reason is null", "frac_noise": f"coalesce(reason in ({Q.NOISE}), false)",
            "frac_question_mark": "contains(text, '?')", "frac_doi": f"{Q.has('text', P.DOI)} or {Q.has('text', P.IDS)}", "frac_year_prefix": Q.has(Q.stripped("text"), P.YEAR_PREFIX), "frac_words_ok": "nw between 8 and 25",
        }.items())
        + ", round(avg(nw::double), 6) mean_words from r group by all",
        "filter_blocklist_copies": f"with {C.LINES_SQL.strip()}, {blocked.strip()}, lk as (select id, pos, {Q.direction_key('line')} k from lines) select distinct id, pos from lk, bk where lk.k <> '' and bk.k <> '' and (lk.k = bk.k or (length(lk.k) >= 40 and length(bk.k) >= 40 and (lk.k[1:80] = bk.k[1:80] or starts_with(bk.k, lk.k[1:80]) or starts_with(lk.k, bk.k[1:80]))))",
    }


ORACLE = _oracle()
