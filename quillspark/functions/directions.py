"""Rules on research directions: prefixes, keys, reasons to reject, scores. All are columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.lines import is_junk, polished
from quillspark.functions.text import contains_any, cut, cut_where, first_words, folded, has, let, n_words, normal_space, spaced, stripped

#: Reasons in the order in which they are tried; those that also mark stored text as noise come before the lengths.
NOISE = (
    "empty", "too_short_chars", "fewshot_copy", "context_copy", "prompt_leak", "instruction_line", "year_prefix",
    "doi_pmid", "comment_in", "author_heavy", "degenerate", "number_only", "junk_sentence", "narrative_here_we",
)
LENGTHS = ("too_few_words", "too_many_words", "question_mark")


def bare(line: Column) -> Column:
    """Without list number or bullet, and without one question mark at the end."""
    text = cut(cut(stripped(line), r"^\d+[.):\-]\s*"), r"^[-*•]\s*")
    return let(text, lambda t: F.when(t.endswith("?"), stripped(_but_last(t))).otherwise(t))


def _but_last(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)


def direction_key(text: Column) -> Column:
    """What exact comparison goes by: bare, lower-cased, single blanks, no punctuation at the end."""
    return stripped(F.rtrim(normal_space(F.lower(bare(text))), F.lit(".,;:!")))


def rejection(text: Column, min_words: int = 8, max_words: int = 25, min_chars: int = 15, copied: Column | None = None) -> Column:
    """The first reason that applies, or null. ``copied`` says whether the text copies a blocked one."""
    return bare_rejection(bare(text), min_words, max_words, min_chars, copied)


def bare_rejection(bare: Column, min_words: int = 8, max_words: int = 25, min_chars: int = 15, copied: Column | None = None) -> Column:
    """The same of a text that is bare already."""
    facts = lambda s: F.struct(s.alias("s"), folded(s).alias("low"), n_words(s).alias("count"))
    return let(let(bare, facts), lambda f: _rejection(f.s, f.low, f["count"], min_words, max_words, min_chars, copied))


def _rejection(s: Column, low: Column, count: Column, min_words: int, max_words: int, min_chars: int, copied: Column | None) -> Column:
    """``low`` is the folded text. Patterns that need a sign or a word are tried where it stands."""
    colon = s.contains(":")
    ids = colon & contains_any(low, "pmid", "pmcid") & has(s, P.IDS)
    tests = {
        "empty": F.length(s) == 0,
        "too_short_chars": F.length(s) < min_chars,
        "fewshot_copy": low.isin(*P.FEWSHOT) & F.lower(s).isin(*P.FEWSHOT),
        "context_copy": F.lit(False) if copied is None else F.coalesce(copied, F.lit(False)),
        "prompt_leak": contains_any(low, *P.LEAK_PARTS) & has(s, P.PROMPT_LEAK),
        "instruction_line": has(s, P.INSTRUCTION),
        "year_prefix": has(s, P.YEAR_PREFIX),
        "doi_pmid": (((colon & low.contains("doi")) | s.contains("10.")) & has(s, P.DOI)) | ids,
        "comment_in": contains_any(low, "comment in", "contributed equally") & has(s, P.COMMENT),
        "author_heavy": (s.contains("(") | (colon & low.contains("collaborator"))) & has(s, P.AUTHOR_HEAVY),
        "degenerate": (s.contains("#") | (s.contains(".") & s.rlike(P.java(r"\d\.")))) & has(s, P.DEGENERATE),
        "number_only": has(s, P.NUMBER_ONLY),
        "junk_sentence": is_junk(s, low),
        "narrative_here_we": (count > 30) & has(s, P.HERE_WE),
        "too_few_words": count < min_words,
        "too_many_words": count > max_words,
        "question_mark": s.endswith("?"),
    }
    reason = None
    for name in NOISE + LENGTHS:
        reason = F.when(tests[name], F.lit(name)) if reason is None else reason.when(tests[name], F.lit(name))
    return reason


def is_noise(reason: Column) -> Column:
    return F.coalesce(reason.isin(*NOISE), F.lit(False))


def is_clean_truth(text: Column) -> Column:
    """Not empty, no noise, at most 40 words."""
    s = stripped(F.coalesce(text, F.lit("")))
    return (F.length(s) > 0) & ~is_noise(rejection(s)) & (n_words(s) <= 40)


def is_leak(text: Column) -> Column:
    """Instruction text rather than a direction; nothing at all counts as that."""
    def leaks(s: Column) -> Column:
        return (F.length(s) == 0) | F.lower(s).isin(*P.FEWSHOT) | has(s, P.PROMPT_LEAK) | has(s, P.INSTRUCTION)

    return let(bare(F.coalesce(text, F.lit(""))), leaks)


def clamped(text: Column, max_words: int = 25) -> Column:
    """Without a mark of repetition, cut to so many words."""
    s = stripped(cut(bare(F.coalesce(text, F.lit(""))), P.REPEAT_MARK))
    return F.when(n_words(s) <= max_words, s).otherwise(cut(first_words(s, max_words), r"[.,;: ]+$"))


def compressed_span(sentence: Column, max_words: int = 25, fewest: int = 5) -> Column:
    """The span that a sentence is about: no filler before, no clause of means after, at most max_words words; null if
    fewer than ``fewest`` are left."""
    s = cut_where(cut(polished(sentence), P.LEADING_FILLER), lambda t: has(t, P.TRAILING_START), P.TRAILING_CLAUSE)
    s = F.btrim(cut_where(s, spaced, r"\s{2,}", " "), F.lit(" .;:"))
    s = cut_where(s, lambda t: t.endswith("?"), r"\s*\?\z")
    return let(s, lambda s: F.when(n_words(s) >= fewest, F.when(n_words(s) > max_words, first_words(s, max_words)).otherwise(s)))


def subjectness(text: Column) -> Column:
    """How much a text reads like a topic, from 0 to 1."""
    return let(text, _subjectness)


def _subjectness(text: Column) -> Column:
    n = n_words(text)
    score = F.lit(0.35) + F.when(n.between(8, 25), 0.25).when(n.between(5, 7) | n.between(26, 40), 0.10).otherwise(-0.15)
    for found, worth in (
        (has(text, P.AIM_CUES), 0.15),
        (has(text, P.FIELD_CUES), 0.15),
        (has(text, P.RESULTS_VERBS), -0.25),
        (has(text, r"^\p{Ll}"), -0.05),
        (text.endswith("?"), -0.05),
    ):
        score = score + F.when(found, worth).otherwise(0.0)
    return F.when((F.length(text) == 0) | is_junk(text) | text.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def prompt_style(style: str | None) -> str:
    return "specific" if (style or "").strip().lower() in P.SPECIFIC_STYLES else "topic"


def polished_direction(text: Column, style: str = "topic") -> Column:
    """A model's line without list mark, label, quotes, narrative start, result clause and dangling word."""
    s = cut(bare(text), P.DIRECTION_LABEL)
    s = cut(s, "^[ \"']+|[ \"']+$")
    s = stripped(cut(s, P.SPECIFIC_PREFIX if prompt_style(style) == "specific" else P.TOPIC_PREFIX))
    s = cut(cut(s, P.RESULT_CLAUSE), r"^[ .;:,]+|[ .;:,]+$")
    return cut(cut(s, P.DANGLING), r"^[ .;:,]+|[ .;:,]+$")


def parsed_direction(raw: Column, style: str = "topic") -> Column:
    """The first line of a model's output that is a direction once polished; else all of it as one line; else null."""
    lines = F.transform(F.split(raw, "\r\n|\r|\n"), lambda line: polished_direction(line, style))
    fit = F.filter(
        lines,
        lambda s: (F.length(s) > 0)
        & ~has(s, r"(?i)^(?:rules:|note:|what is the main research direction)")
        & ~has(s, r"^[-\s]+$"),
    )
    whole = polished_direction(F.replace(raw, F.lit("\n"), F.lit(" ")), style)
    found = F.coalesce(F.get(fit, F.lit(0)), F.nullif(whole, F.lit("")))
    return F.when(F.length(stripped(raw)) > 0, found)


def diagnosed(text: Column, min_words: int = 8, max_words: int = 25) -> Column:
    """struct(text, reason): the best span of a direction, and why it is rejected, or null."""
    none = text.isNull() | (F.length(stripped(text)) == 0)

    def judged(best: Column) -> Column:
        empty = none | (F.length(best) == 0)
        reason = F.when(empty, F.lit("empty")).otherwise(rejection(best, min_words, max_words))
        return F.struct(F.when(~empty, best).alias("text"), reason.alias("reason"))

    return let(F.coalesce(compressed_span(text, max_words, min_words), bare(text)), judged)


def generated_list(text: Column, min_chars: int = 15) -> Column:
    """The lines of a model's output, bare and long enough, the first of equal ones (in lower case) each; if there is
    none, all of it as one line."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), bare), lambda s: F.length(s) >= min_chars)
    alone = lambda both: F.filter(both["l"], lambda s, k: F.array_position(both["w"], F.lower(s)) == k + 1)
    first = let(let(lines, lambda found: F.struct(found.alias("l"), F.transform(found, F.lower).alias("w"))), alone)
    whole = bare(F.replace(text, F.lit("\n"), F.lit(" ")))
    none = F.array().cast("array<string>")
    return let(first, lambda found: F.when(F.size(found) > 0, found).when(F.length(whole) >= min_chars, F.array(whole)).otherwise(none))


def weighted_impact(impact: Column, score: Column, floor: float = 0.15) -> Column:
    return F.coalesce(impact, F.lit(0.0)) * F.greatest(F.lit(floor), score)


def extraction_score(span: Column, label: Column, confidence: Column, floor: float = 0.55, least: float = 0.35) -> Column:
    """The score of a valid extracted direction: the heuristic one or the floor, changed by the class."""
    score = F.greatest(subjectness(span), F.lit(floor))
    score = F.when(label == "noise", score * 0.5).when(label == "methods", score * 0.7).otherwise(F.least(F.lit(1.0), score + 0.15 * confidence))
    return F.greatest(score, F.lit(least))


def resolved_subject(
    question: Column, abstract: Column, qc: Column, method: Column, label: Column | None = None, confidence: Column | None = None,
    min_words: int = 8, max_words: int = 25, fewest: int = 5, least: float = 0.35,
) -> Column:
    """struct(text, score) of a stored draft: kept if it is a valid model's draft or good enough, drawn anew from the
    draft or the abstract otherwise; a null text is a rejection."""
    draft = stripped(F.coalesce(question, F.lit("")))
    known = F.coalesce(qc, F.lit(0.0))
    by_model = F.coalesce(F.lower(method).contains("llm"), F.lit(False)) & (F.length(draft) > 0)
    valid = rejection(draft, min_words, max_words).isNull()
    n = n_words(draft)
    anew = qc.isNull() | (known < least) | (n > max_words + 5) | (n < fewest)
    made = lambda text, value: F.struct(text.cast("string").alias("text"), value.cast("double").alias("score"))
    none = F.lit(None)

    def again(span: Column) -> Column:
        score = subjectness(span)
        if label is not None:
            score = F.when(label == "noise", score * 0.15).when(label == "methods", score * 0.35).otherwise(F.least(F.lit(1.0), score + 0.15 * confidence))
        return let(score, lambda value: F.when(span.isNull(), made(none, known)).when(value < least, made(none, value)).otherwise(made(span, value)))

    source = F.when(F.length(draft) > 0, draft).otherwise(F.coalesce(abstract, F.lit("")))
    return (
        F.when(by_model & valid, made(draft, F.greatest(known, F.lit(least))))
        .when(by_model, made(none, known))
        .when(~anew & (F.length(draft) > 0), made(draft, known))
        .otherwise(let(compressed_span(source, max_words, fewest), again))
    )


def near_key(text: Column) -> Column:
    """What is compared by meaning: without a mark of repetition, unless nothing else is left."""
    return F.coalesce(F.nullif(stripped(cut(text, P.NEAR_REPEAT_MARK)), F.lit("")), text)
