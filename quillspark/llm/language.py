"""Language identification by compression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import sliced, texts
from quillspark.llm.compression import chunks, compressor, drawn, fold, piece, raw_dictionary, total_size
from quillspark.sources.tables import table

#: The sample that is learned from: so many texts of a language, a piece of each, so many bytes of dictionary.
TEXTS, PIECE, DICTIONARY = 250, 500, 100 << 10
LEVEL = 6
#: Of a text's first bytes, so many, what follows each word counts as well, at a level that finds shorter matches: the size
#: of a short text alone is too coarse.
OPENING, OPENING_LEVEL = 100, 12
#: A prediction is rejected if the best size isn't smaller than the second by this share.
MARGIN = 0.01
#: How fast the score rises with the ratio of sizes.
STEEPNESS = 20.0
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def letters(text: str) -> bytes:
    """Lower-cased letters, with a space for any run of others."""
    return _OTHER.sub(" ", text.lower()).strip().encode()


def has_letter(text: str) -> bool:
    """Numerals such as fractions are word characters, but no letters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def openings(data: bytes) -> list[bytes]:
    """What follows each word in a text's opening."""
    opening = data[:OPENING]
    return [opening[k + 1 :] for k, c in enumerate(opening) if c == 32]


@dataclass(frozen=True)
class Languages:
    """A dictionary of raw text for each language."""

    contents: tuple[tuple[str, bytes], ...]

    @classmethod
    def learned(cls, labelled: DataFrame) -> Languages:
        """From text and lang, and doc_id to draw a bounded sample by; rows with a null in text or lang are left out."""
        known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
        sample = drawn(known.select("doc_id", "text", "lang"), "lang", F.struct("doc_id", "text"), TEXTS)
        rows = sample.select("lang", "doc_id", piece(F.col("text"), PIECE).alias("text")).collect()
        contents: dict[str, bytes] = {}
        for lang, _, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
            part = letters(text)
            if part and len(contents.setdefault(lang, b"")) < DICTIONARY:
                contents[lang] += part + b" "
        return cls(tuple(sorted((lang, content) for lang, content in contents.items() if content)))

    def compressors(self):
        """(language, compress, compress openings) for each language."""
        made = lambda content, level: compressor(raw_dictionary(content), level).compress
        return [(lang, made(content, LEVEL), made(content, OPENING_LEVEL)) for lang, content in self.contents]


def judged(compressors, text: str) -> tuple[str, float, bool]:
    """The language of a text, a score and whether the margin is too narrow."""
    if not compressors or not has_letter(text):
        return UNKNOWN, 0.0, True
    if len(compressors) == 1:
        return compressors[0][0], 1.0, False
    data = letters(text)
    parts, first = chunks(data), openings(data)
    sizes = np.array([total_size(whole, parts) + total_size(opening, first) for _, whole, opening in compressors], float)
    best = int(sizes.argmin())
    second = np.delete(sizes, best).min()
    score = 1.0 / ((sizes[best] / sizes) ** STEEPNESS).sum()
    return compressors[best][0], float(score), bool(1.0 - sizes[best] / second < MARGIN)


def identified(docs: DataFrame, languages: Languages) -> DataFrame:
    """Adds lang_pred, score and rejected to docs (doc_id, text and any others; columns of these names are replaced).

    The language whose dictionary compresses the whole text best is chosen; ties go to the first by name and are
    rejected, as are texts whose two best sizes are close and texts that are null or have no letter, which are ``und``
    with score 0. So are all texts if no language was learned. Nothing but the text has a say; rows are independent, so
    repeats give repeats. Long texts count whole, chunk by chunk. An empty table gives an empty one.
    """
    schema = docs.drop("lang_pred", "score", "rejected").schema
    others = schema.fieldNames()
    out = schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = languages.compressors()
        for batch in sliced(batches):
            found = [judged(compressors, t) for t in texts(batch).to_pylist()]
            columns = [pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.select(*others).mapInArrow(run, out)


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    languages = Languages.learned(docs.filter(~held))
    found = identified(docs.select("doc_id", "text"), languages)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op9_language": op9_language}
ORACLE: dict[str, str] = {}
