"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import patterns as P


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has(text: Column, pattern: str) -> Column:
    """Whether a pattern is found anywhere; a null text has none."""
    return F.coalesce(text.rlike(P.java(pattern)), F.lit(False))


def cut(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, P.java(pattern), by)


def cut_where(text: Column, needs, pattern: str, by: str = "") -> Column:
    """cut, where ``needs`` says of a text that the pattern may be there: a search for one sign takes little beside it."""
    return let(text, lambda t: F.when(needs(t), cut(t, pattern, by)).otherwise(t))


def contains_any(text: Column, *parts: str) -> Column:
    """Whether any of these parts stands in the text."""
    found = text.contains(parts[0])
    for part in parts[1:]:
        found |= text.contains(part)
    return found


def folded(text: Column) -> Column:
    """In lower case, with the four signs outside ASCII that patterns take for ASCII letters where they ignore case: what a
    pattern finds has its ASCII letters here."""
    plain = text
    for sign, letter in zip("ſKıİ", "skii", strict=True):
        plain = F.replace(plain, F.lit(sign), F.lit(letter))
    return F.lower(F.when(text.rlike(r"[^\x00-\u012f]"), plain).otherwise(text))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(P.SPACES))


def spaced(text: Column) -> Column:
    """Whether there may be white space other than single blanks: it is in one of the gaps of these ranges, of which the first
    holds most signs, so that most are looked at once."""
    return text.contains("  ") | text.rlike(r"[^ -~\u00a1-\u167f\u3001-\uffff]")


def normal_space(text: Column) -> Column:
    """Stripped, and any run of white space one blank."""
    return cut_where(stripped(text), spaced, r"\s+", " ")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.java(r"(\S+)")), F.lit(1))


def n_words(text: Column) -> Column:
    def count(s: Column) -> Column:
        blanks = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
        return F.when(F.length(s) == 0, 0).when(spaced(s), F.size(words(s))).otherwise(blanks + 1)

    return let(stripped(F.coalesce(text, F.lit(""))), count)


def first_words(text: Column, n: int) -> Column:
    """At most n words, joined by blanks; null is empty."""
    return F.array_join(F.slice(words(F.coalesce(text, F.lit(""))), 1, n), " ")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and Greek, with one inner hyphen or apostrophe."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({P.WORD})"), F.lit(1))
    return F.transform(found, F.lower)


def trigrams(text: Column) -> Column:
    """Each three tokens in a row; of fewer all; of none none."""
    none = F.array().cast("array<string>")

    def grams(found: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(found) - 2), lambda k: F.array_join(F.slice(found, k, 3), " "))
        return F.when(F.size(found) >= 3, runs).when(F.size(found) > 0, F.array(F.array_join(found, " "))).otherwise(none)

    return let(tokens(text), grams)


def verbatim_key(text: Column) -> Column:
    """Lower-cased words joined by blanks."""
    return F.array_join(words(F.lower(text)), " ")


def or_else(text: Column, other: Column) -> Column:
    """The other value for a null or an empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def preview(text: Column, chars: int = 200) -> Column:
    """Stripped, with plain line ends, cut with an ellipsis."""
    plain = stripped(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"))
    return F.when(F.length(plain) > chars, F.concat(F.rtrim(F.substring(plain, 1, chars)), F.lit("..."))).otherwise(plain)


def capped(text: Column, chars: int) -> Column:
    """At most so many characters, the last three an ellipsis if it is cut."""
    return F.when(F.length(text) > chars, F.concat(cut(F.substring(text, 1, chars - 3), r"\s+$"), F.lit("..."))).otherwise(text)
