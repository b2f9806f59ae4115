"""Quality classification by compression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import sliced, texts
from quillspark.llm.compression import chunks, compressor, drawn, fold, piece, raw_dictionary, total_size
from quillspark.sources.tables import table

#: The sample that is learned from: so many texts of a label for its dictionary and so many others to calibrate with,
#: a piece of at most so many characters of each.
TEXTS, CALIBRATING, PIECE = 1500, 1500, 8000
DICTIONARY = 100 << 10
LEVEL = 3
#: Texts are compressed under the dictionaries in chunks of so many bytes.
CHUNK = 512
#: A score from here on counts as good.
GOOD = 0.3


def _dictionary(samples: list[bytes]):
    """A trained dictionary; of the samples as they are if they are too few to train with."""
    import zstandard

    if sum(map(len, samples)) > 8 * DICTIONARY:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes(), True
        except zstandard.ZstdError:
            pass
    return b"\n".join(samples)[:DICTIONARY], False


def _loaded(content: bytes, trained: bool):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if trained else raw_dictionary(content)


def fitted_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Slopes and offset of the logistic curve of y over the columns of x, with a weak ridge on scaled columns."""
    mean, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 1e-2 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return (*map(float, slopes), float(w[-1] - slopes @ mean))


@dataclass(frozen=True)
class Quality:
    """Dictionaries of bad and good text, and the curve from sizes to scores: the slope of the normalised difference of
    sizes under the two, that of the log of the size without a dictionary, and the offset."""

    bad: tuple[bytes, bool]
    good: tuple[bytes, bool]
    curve: tuple[float, float, float]
    #: What an empty text's log size counts as: the mean of the texts that were learned from.
    typical: float = 0.0

    @classmethod
    def learned(cls, docs: DataFrame, labels: DataFrame) -> Quality:
        """From labels (doc_id, quality) and the texts of docs (doc_id, text), by a bounded sample of the labels.

        Labels other than 0 and 1, nulls and labels without a document teach nothing. With one label or none the score
        is constant: the share of good texts, smoothed.
        """
        known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
        few = drawn(known, "quality", F.col("doc_id"), TEXTS + CALIBRATING)
        held = docs.select("doc_id", piece(F.col("text"), PIECE).alias("text")).filter("text is not null")
        # At most 2 * (TEXTS + CALIBRATING) labels; of documents with one id the one with the least hash is taken.
        joined = held.join(F.broadcast(few), "doc_id").select("doc_id", "quality", F.struct(F.xxhash64("text").alias("h"), "text").alias("t"))
        rows = joined.groupBy("doc_id", "quality").agg(F.min("t").alias("t")).select("doc_id", "quality", "t.text", F.xxhash64("doc_id").alias("h")).collect()
        rows = sorted((r.h, r.doc_id, r.quality, r.text.encode()) for r in rows)
        by = {q: [r[3] for r in rows if r[2] == q] for q in (0, 1)}
        if not by[0] or not by[1]:
            share = (len(by[1]) + 1) / (len(rows) + 2)
            return cls((b"", False), (b"", False), (0.0, 0.0, float(np.log(share / (1 - share)))))
        cut = {q: max(1, min(TEXTS, len(by[q]) * 2 // 3)) for q in by}
        bad, good = (_dictionary(by[q][: cut[q]]) for q in (0, 1))
        rest = [(t, q) for q in by for t in (by[q][cut[q] :] or by[q])]
        measure = cls(bad, good, (0.0, 0.0, 0.0)).measure()
        x, y = np.array([measure(t) for t, _ in rest]), np.array([q for _, q in rest], float)
        return cls(bad, good, fitted_logistic(x, y), float(x[:, 1].mean()))

    def measure(self):
        """A function from a text's bytes to what the good dictionary saves over the bad one, in bytes a byte, and to the
        log of the text's size without a dictionary, in bytes a byte; for no text to 0 and what is typical."""
        bad, good = (compressor(_loaded(*d), LEVEL).compress for d in (self.bad, self.good))
        plain = compressor(None, LEVEL).compress

        def measured(data: bytes) -> tuple[float, float]:
            if not data:
                return 0.0, self.typical
            parts = chunks(data, CHUNK)
            return (total_size(bad, parts) - total_size(good, parts)) / len(data), float(np.log(len(plain(data)) / len(data)))

        return measured


def rated(docs: DataFrame, quality: Quality, good: float = GOOD) -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (1 from ``good`` on, else 0) to docs (text and any others).

    The score is a function of the whole text alone; null and empty texts get the curve's value at no
    difference and a typical size.
    Columns named score and predicted are replaced; rows are independent, so repeated rows get equal results. Long texts
    count whole, chunk by chunk. An empty table gives an empty one.
    """
    schema = docs.drop("score", "predicted").schema
    names = schema.fieldNames()
    out = schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = quality.measure()
        first, second, offset = quality.curve
        for batch in sliced(batches):
            x = np.array([measure(t.encode()) for t in texts(batch).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(first * x[:, 0] + second * x[:, 1] + offset, -700, 700)))
            columns = [pa.array(score), pa.array((score >= good).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "score", "predicted"])

    return docs.select(*names).mapInArrow(run, out)


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    quality = Quality.learned(docs, labels.filter(~held))
    return rated(docs, quality).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op7_quality": op7_quality}
ORACLE: dict[str, str] = {}
