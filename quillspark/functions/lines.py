"""Predicates and clean-up of lines of article exports, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.text import contains_any, cut, cut_where, folded, has, let, normal_space, spaced, stripped


def is_citation(line: Column) -> Column:
    """A numbered journal line with a year, a line that goes on with an id or Epub, or one that ends in ``doi:``."""
    patterns = (P.JOURNAL_CITATION, P.CITATION_CONTINUATION, P.CITATION_DOI_END)
    return let(stripped(line), lambda text: has(text, patterns[0]) | has(text, patterns[1]) | has(text, patterns[2]))


def header_name(header: Column) -> Column:
    """The canonical name of a section header."""
    upper = cut(F.upper(normal_space(header)), r":+$")
    name = F.lit(None).cast("string")
    for start, canonical in reversed(P.HEADER_STARTS):
        name = F.when(upper.startswith(start), F.lit(canonical)).otherwise(name)
    return F.coalesce(name, upper)


def header_bucket(name: Column) -> Column:
    """question, results or null."""
    return F.when(name.isin(*P.QUESTION_HEADERS), "question").when(name.isin(*P.RESULTS_HEADERS), "results")


def is_header(text: Column) -> Column:
    """Whether a line starts with a section header."""
    return has(text, P.SECTION_HEADER.replace("(?im)", "(?i)"))


def is_institution(text: Column) -> Column:
    return let(folded(text), lambda low: _is_institution(text, low))


def _is_institution(text: Column, low: Column) -> Column:
    prose = has(text, P.PROSE)
    named = (F.length(text) < 220) & _affiliated(text, low) & ~is_header(text) & ~prose
    postal = text.rlike(P.java(r"\d")) & has(text, P.POSTAL_LINE) & ~prose
    return has(text, P.INSTITUTION_START) | postal | named


def _affiliated(text: Column, low: Column) -> Column:
    return contains_any(low, *P.AFFILIATION_PARTS) & has(text, P.AFFILIATION_WORDS)


def is_metadata(line: Column) -> Column:
    """Names, affiliations, addresses and places rather than prose; the first rule that applies decides."""
    return let(stripped(line), lambda text: let(folded(text), lambda low: _is_metadata(text, low)))


def _is_metadata(text: Column, low: Column) -> Column:
    """``low`` is the folded text. Patterns that need a sign are tried where it stands, as most lines have none."""
    prose, indexed = has(text, P.PROSE), text.contains("(")
    names = (text.contains(",") & has(text, P.CITY_COUNTRY)) | has(text, P.STANDALONE_AUTHOR) | (indexed & (has(text, P.AUTHOR_ONLY) | has(text, P.AUTHOR_LINE)))
    places = (indexed & has(text, P.AFFILIATION_LINE)) | (text.contains("@") & has(text, P.EMAIL)) | (low.contains("address:") & has(text, P.ADDRESS)) | has(text, P.COUNTRY_LINE)
    rest = places | _is_institution(text, low) | (has(text, P.POSTAL_START) & ~prose)
    return (
        F.when(F.length(text) == 0, False)
        .when(names, True)
        .when(indexed & has(text, P.INDEXED_AUTHOR) & ~prose, F.length(text) < 280)
        .otherwise(rest)
    )


def is_junk(sentence: Column, low: Column | None = None) -> Column:
    """What no direction is drawn from: short, metadata, ids, notes. ``low`` is the folded sentence, where it is known."""
    known = lambda text: folded(text) if low is None else F.when(text == sentence, low).otherwise(folded(text))
    return let(normal_space(sentence), lambda text: let(known(text), lambda low: _is_junk(text, low)))


def _is_junk(text: Column, low: Column) -> Column:
    ids, comment, equally, group, update = P.JUNK
    indexed, colon = text.contains("("), text.contains(":")
    found = (F.length(text) < 12) | _is_metadata(text, low) | (indexed & has(text, P.AUTHOR_ONLY)) | has(text, P.STANDALONE_AUTHOR)
    found |= _affiliated(text, low) & ~has(text, P.PROSE)
    found |= colon & contains_any(low, "doi", "pmid", "pmcid") & has(text, ids)
    found |= low.contains("comment in") & has(text, comment)
    found |= indexed & low.contains("contributed equally") & has(text, equally)
    found |= colon & low.contains("collaborator") & has(text, group)
    found |= low.contains("update of") & has(text, update)
    brackets = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    return found | (indexed & has(text, P.HEAVY_INDEX) & (brackets >= 3))


def polished(text: Column) -> Column:
    """Without addresses and indexed authors; runs of white space become one blank."""
    for sign, pattern in (("@", P.EMAIL), (":", P.ADDRESS), ("(", P.INDEXED_AUTHOR)):
        text = cut_where(text, lambda t, sign=sign: t.contains(sign), pattern, " ")
    return stripped(cut_where(cut_where(text, lambda t: t.contains("("), P.LEADING_AUTHOR), spaced, r"\s{2,}", " "))


def without_title(text: Column, title: Column) -> Column:
    """Drops a first line that repeats the title: it starts as the title does, at three quarters of its length."""
    name = normal_space(F.coalesce(title, F.lit("")))
    first = normal_space(F.substring_index(text, "\n", 1))
    start = F.left(F.lower(name), F.least(F.length(name), F.length(first)))
    same = F.lower(first).startswith(start) & (F.length(first) >= F.length(name) * 0.75)
    rest = F.when(F.instr(text, "\n") > 0, stripped(F.regexp_replace(text, r"^[^\n]*\n", ""))).otherwise("")
    return F.when((F.length(name) >= 12) & (F.length(text) > 0) & same, rest).otherwise(text)


def inferred_year(block: Column, last_year: int) -> Column:
    """A year after a month, or of a collection, or from 2000 to last_year among the first 400 characters."""
    at = lambda text, pattern: F.nullif(F.regexp_extract(text, P.java(pattern), 1), F.lit("")).cast("int")
    early = at(F.substring(block, 1, 400), P.CENTURY_YEAR)
    return F.coalesce(at(block, P.MONTH_YEAR), at(block, P.COLLECTION_YEAR), F.when(early.between(2000, last_year), early))
