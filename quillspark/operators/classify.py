"""Nearest-prototype classes of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.models import Encoder, pieces
from quillspark.functions.patterns import PROTOTYPES


def centroids(encoder: Encoder, prototypes: dict[str, tuple[str, ...]] | None = None) -> dict[str, np.ndarray]:
    """The mean vector of each class's sentences, at length 1."""
    out = {}
    for label, sentences in (PROTOTYPES if prototypes is None else prototypes).items():
        mean = encoder.encode(list(sentences)).mean(axis=0)
        norm = float(np.linalg.norm(mean))
        out[label] = mean / norm if norm > 0 else mean
    return out


def classified(df: DataFrame, text: str, encoder: Encoder | None) -> DataFrame:
    """Adds label and confidence: the class of the nearest centroid, and how near it is and how far before the next.
    Blank texts, and all where there is no encoder, are ``subject`` with no confidence."""
    if encoder is None:
        return df.withColumns({"label": F.lit("subject"), "confidence": F.lit(0.0)})
    named = centroids(encoder)
    labels, matrix = list(named), np.stack(list(named.values()))

    @F.arrow_udf("label string, confidence double")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for piece in pieces(batches):
            plain = piece.fill_null("").to_pylist()
            scores = encoder.encode(plain) @ matrix.T
            ordered = np.sort(scores, axis=1)[:, ::-1]
            sure = np.clip((ordered[:, 0] + 1) / 2 * (0.5 + 0.5 * np.maximum(ordered[:, 0] - ordered[:, 1], 0)), 0, 1)
            blank = np.array([not t.strip() for t in plain], bool)
            found = np.where(blank, "subject", np.array(labels)[scores.argmax(axis=1)])
            yield pa.StructArray.from_arrays([pa.array(found.tolist(), pa.string()), pa.array(np.where(blank, 0.0, sure).astype(float))], ["label", "confidence"])

    made = df.withColumn("__class", nearest(F.col(text)))
    return made.select(*df.columns, "__class.label", "__class.confidence")
