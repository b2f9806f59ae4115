"""The text rules as DuckDB SQL fragments, to check the columns against."""

from __future__ import annotations

from quillspark.functions import patterns as P


def has(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, '{P.re2(pattern)}'), false)"


def cut(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{P.re2(pattern)}', '{by}', 'g')"


def stripped(x: str) -> str:
    return cut(x, r"^\s+|\s+$")


def normal_space(x: str) -> str:
    return cut(stripped(x), r"\s+", " ")


def words(x: str) -> str:
    return rf"regexp_extract_all(coalesce({x}, ''), '\S+')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def first_words(x: str, n: int) -> str:
    return f"array_to_string({words(x)}[1:{n}], ' ')"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{P.re2(P.WORD)}'), lambda w: lower(w))"


def is_citation(x: str) -> str:
    s = stripped(x)
    return f"({has(s, P.JOURNAL_CITATION)} or {has(s, P.CITATION_CONTINUATION)} or {has(s, P.CITATION_DOI_END)})"


def is_header(s: str) -> str:
    return has(s, P.SECTION_HEADER.replace("(?im)", "(?i)"))


def is_metadata(s: str) -> str:
    """Of text that is stripped already."""
    prose = has(s, P.PROSE)
    named = f"({has(s, P.AFFILIATION_WORDS)} and not {is_header(s)} and not {prose} and length({s}) < 220)"
    institution = f"({has(s, P.INSTITUTION_START)} or ({has(s, P.POSTAL_LINE)} and not {prose}) or {named})"
    names = " or ".join(has(s, p) for p in (P.CITY_COUNTRY, P.AUTHOR_ONLY, P.STANDALONE_AUTHOR, P.AUTHOR_LINE))
    places = " or ".join(has(s, p) for p in (P.AFFILIATION_LINE, P.EMAIL, P.ADDRESS, P.COUNTRY_LINE))
    return (
        f"(case when {s} = '' then false when {names} then true when {has(s, P.INDEXED_AUTHOR)} and not {prose} then length({s}) < 280"
        f" else ({places} or {institution} or ({has(s, P.POSTAL_START)} and not {prose})) end)"
    )


def is_junk(s: str) -> str:
    """Of text with normal space already."""
    tests = [f"length({s}) < 12", is_metadata(s), has(s, P.AUTHOR_ONLY), has(s, P.STANDALONE_AUTHOR)]
    tests += [f"({has(s, P.AFFILIATION_WORDS)} and not {has(s, P.PROSE)})", *(has(s, p) for p in P.JUNK)]
    tests.append(f"({has(s, P.HEAVY_INDEX)} and length({s}) - length(replace({s}, '(', '')) >= 3)")
    return f"({' or '.join(tests)})"


def polished(x: str) -> str:
    for pattern in (P.EMAIL, P.ADDRESS, P.INDEXED_AUTHOR):
        x = cut(x, pattern, " ")
    return stripped(cut(cut(x, P.LEADING_AUTHOR), r"\s{2,}", " "))


def without_title(text: str, title: str) -> str:
    """Of columns."""
    first, name = normal_space(f"string_split({text}, chr(10))[1]"), normal_space(f"coalesce({title}, '')")
    rest = stripped(f"case when contains({text}, chr(10)) then {text}[strpos({text}, chr(10)) + 1:] else '' end")
    same = f"starts_with(lower({first}), lower({name})[1:least(length({name}), length({first}))]) and length({first}) >= length({name}) * 0.75"
    return f"(case when length({name}) >= 12 and {text} <> '' and {same} then {rest} else {text} end)"


def cleaned(source: str) -> str:
    """Common table expressions that end in cleaned (id, cleaned), of a table (id, title, text)."""
    kept = f"s = '' or not ({has('s', P.AUTHOR_INFO)} or {has('s', P.ID_TAIL)} or {is_metadata('s')})"
    return f"""cl as (select id, title, string_split({cut('text', P.AUTHOR_INFO_BLOCK)}, chr(10)) ls from {source}), cu as (select id, title, unnest(ls) raw, generate_subscripts(ls, 1) i from cl),
        cs as (select id, title, i, {stripped('raw')} s from cu), cm as (select *, min(i) filter ({has('s', P.LEGAL_START)}) over (partition by id) stop from cs),
        ck as (select id, any_value(title) title, {stripped(f"coalesce(string_agg({polished('s')}, chr(10) order by i) filter ((stop is null or i < stop) and ({kept})), '')")} t from cm group by id),
        ct as (select id, {without_title('t', 'title')} t from ck), cleaned as (select id, {polished('t')} cleaned from ct)"""


def section_pieces(text: str) -> str:
    """A text's stretches that begin with a section header, and what is before the first; RE2 has no look-behind."""
    inline = P.SECTION_INLINE.replace(r"(?<=[.;])", r"([.;])")
    laid = f"regexp_replace({text}, '{inline}', '\\1' || chr(10) || '\\2: ', 'g')"
    marked = f"regexp_replace({laid}, '(?im)^((?:{P.HEADERS})\\s*:)', chr(1) || '\\1', 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda p, k: k > 1 or p <> '')"


def header_of(piece: str) -> str:
    return f"regexp_extract({piece}, '(?i)^({P.HEADERS})\\s*:', 1)"


def after_header(piece: str) -> str:
    return cut(piece, rf"(?i)\A(?:{P.HEADERS})\s*:\s*")


def header_name(header: str) -> str:
    upper = cut(f"upper({normal_space(header)})", ":+$")
    names = " ".join(f"when starts_with({upper}, '{a}') then '{b}'" for a, b in P.HEADER_STARTS)
    return f"(case {names} else {upper} end)"


def header_bucket(name: str) -> str:
    quoted = lambda found: ", ".join(f"'{x}'" for x in found)
    return f"(case when {name} in ({quoted(P.QUESTION_HEADERS)}) then 'question' when {name} in ({quoted(P.RESULTS_HEADERS)}) then 'results' end)"


def bare(x: str) -> str:
    return stripped(cut(cut(cut(stripped(x), r"^\d+[.):\-]\s*"), r"^[-*•]\s*"), r"\?\z"))


def direction_key(x: str) -> str:
    return stripped(cut(normal_space(f"lower({bare(x)})"), r"[.,;:!]+$"))


def rejection(s: str, ns: str, min_words: int = 8, max_words: int = 25, copied: str = "false") -> str:
    """Of bare text s and the same with normal space ns, both columns."""
    n, few = n_words(s), ", ".join(f"'{f}'" for f in P.FEWSHOT)
    tests = [
        ("empty", f"{s} = ''"), ("too_short_chars", f"length({s}) < 15"), ("fewshot_copy", f"lower({s}) in ({few})"), ("context_copy", copied),
        ("prompt_leak", has(s, P.PROMPT_LEAK)), ("instruction_line", has(s, P.INSTRUCTION)), ("year_prefix", has(s, P.YEAR_PREFIX)),
        ("doi_pmid", f"({has(s, P.DOI)} or {has(s, P.IDS)})"), ("comment_in", has(s, P.COMMENT)), ("author_heavy", has(s, P.AUTHOR_HEAVY)),
        ("degenerate", has(s, P.DEGENERATE)), ("number_only", has(s, P.NUMBER_ONLY)), ("junk_sentence", is_junk(ns)),
        ("narrative_here_we", f"({has(s, P.HERE_WE)} and {n} > 30)"), ("too_few_words", f"{n} < {min_words}"), ("too_many_words", f"{n} > {max_words}"),
        ("question_mark", f"{s}[-1] = '?'"),
    ]
    return "(case " + " ".join(f"when {test} then '{name}'" for name, test in tests) + " end)"


NOISE = ", ".join(f"'{r}'" for r in (
    "empty", "too_short_chars", "fewshot_copy", "context_copy", "prompt_leak", "instruction_line", "year_prefix", "doi_pmid",
    "comment_in", "author_heavy", "degenerate", "number_only", "junk_sentence", "narrative_here_we",
))


def clean_truth(x: str) -> str:
    s = bare(x)
    return f"({stripped(x)} <> '' and coalesce({rejection(s, normal_space(s))} not in ({NOISE}), true) and {n_words(x)} <= 40)"


def span(x: str, fewest: int = 5, most: int = 25) -> str:
    s = cut(cut(polished(x), P.LEADING_FILLER), P.TRAILING_CLAUSE)
    s = cut(cut(cut(s, r"\s{2,}", " "), r"^[ .;:]+|[ .;:]+$"), r"\s*\?\z")
    return f"(case when {n_words(s)} < {fewest} then null when {n_words(s)} > {most} then {first_words(s, most)} else {s} end)"


def subjectness(x: str, ns: str) -> str:
    """Of a column x and the same with normal space."""
    n = n_words(x)
    parts = [f"0.35::double + case when {n} between 8 and 25 then 0.25::double when {n} between 5 and 7 or {n} between 26 and 40 then 0.10::double else -0.15::double end"]
    for test, worth in ((has(x, P.AIM_CUES), 0.15), (has(x, P.FIELD_CUES), 0.15), (has(x, P.RESULTS_VERBS), -0.25), (has(x, r"^\p{Ll}"), -0.05), (f"{x}[-1] = '?'", -0.05)):
        parts.append(f"case when {test} then {worth}::double else 0.0::double end")
    return f"(case when {x} is null or {x} = '' or {is_junk(ns)} then 0.0::double else greatest(0.0::double, least(1.0::double, {' + '.join(parts)})) end)"


def polished_direction(x: str, prefix: str = P.TOPIC_PREFIX) -> str:
    s = cut(cut(bare(x), P.DIRECTION_LABEL), "^[ \"']+|[ \"']+$")
    s = cut(cut(stripped(cut(s, prefix)), P.RESULT_CLAUSE), r"^[ .;:,]+|[ .;:,]+$")
    # RE2's word boundary knows ASCII letters only.
    dangling = P.DANGLING.replace(r"\b", r"(^|[^\w])")
    return cut(cut(s, dangling, r"\1"), r"^[ .;:,]+|[ .;:,]+$")
