"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import sliced
from quillspark.llm.shared import partitions
from quillspark.sources.tables import table

#: Levels whose phrase names make up a fingerprint, the slots that they are dealt to, and the levels that are built.
LEVELS = (2, 3, 4)
SLOTS = 64
#: Rounds of coin tossing: labels of 64-bit names shrink to under 128, 14, 8.
ROUNDS = 3
#: Code points that are parsed at once; a longer text alone.
FLAT_CHARS = 1 << 18
_FIRST = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Weights of the places in a phrase; local minima are less than this far apart.
_WEIGHTS = _mixed(np.arange(64, dtype=np.uint64)) | np.uint64(1)


def _collapsed(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Makes each run of equal names one name, of the name and the run's length; neighbours then differ."""
    begins = np.empty(len(names), bool)
    begins[1:] = names[1:] != names[:-1]
    begins[starts] = True
    if begins.all():
        return names, starts
    places = np.flatnonzero(begins)
    lengths = np.diff(places, append=len(names))
    kept = names[places]
    long = lengths > 1
    kept[long] = _mixed(kept[long] ^ _mixed(lengths[long].astype(np.uint64)))
    return kept, np.searchsorted(places, starts)


def _tossed(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Small labels by which neighbours differ: twice the place of the lowest bit in which a name differs from the one
    before it, plus that bit; then the same over the labels."""
    labels = names
    for _ in range(ROUNDS):
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[starts] = ~labels[starts]
        differ = labels ^ before
        place = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1))
        bit = (labels >> place.astype(labels.dtype)) & labels.dtype.type(1)
        labels = (place << np.uint8(1)) | bit.astype(np.uint8)
    return labels


def _phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: phrases begin where a label is less than both neighbours; a phrase's name is that of its names."""
    names, starts = _collapsed(names, starts)
    labels = _tossed(names, starts)
    begins = np.zeros(len(names), bool)
    begins[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
    begins[starts[1:] - 1] = False
    begins[starts] = True
    places = np.flatnonzero(begins)
    lengths = np.diff(places, append=len(names))
    within = np.minimum(np.arange(len(names)) - np.repeat(places, lengths), len(_WEIGHTS) - 1)
    sums = np.add.reduceat(_mixed(names) * _WEIGHTS[within], places)
    return _mixed(sums ^ lengths.astype(np.uint64)), np.searchsorted(places, starts)


def signatures(texts: list[str]) -> np.ndarray:
    """SLOTS numbers of 16 bits for each text, 0 for an empty slot.

    Phrases of the first level are stretches of characters, those of the next stretches of phrases, and so on; where a
    phrase begins depends on a few neighbours alone, so equal stretches of text have the same phrases but for their
    ends. Names of LEVELS, or of the highest level if that is lower, are dealt to slots, and each slot keeps its least.
    """
    out = np.zeros((len(texts), SLOTS), np.uint16)
    filled = np.flatnonzero([bool(t) for t in texts])
    if not len(filled):
        return out
    lengths = np.array([len(texts[k]) for k in filled])
    flat = "".join(texts[k] for k in filled).encode("utf-32-le", "surrogatepass")
    names = np.frombuffer(flat, "<u4").astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    least = np.full((len(filled), SLOTS), 0xFFFFFFFF, np.uint32)
    alone = np.zeros(len(filled), bool)
    for level in range(1, max(LEVELS) + 1):
        names, starts = _phrases(names, starts)
        counts = np.diff(starts, append=len(names))
        # A text of one phrase keeps it as its top; only the first such level counts.
        use = (counts > 1) if level in LEVELS else np.zeros(len(filled), bool)
        use |= (counts == 1) & ~alone
        alone |= counts == 1
        owner = np.repeat(np.arange(len(filled)), counts)
        chosen = use[owner]
        picked, owner = names[chosen], owner[chosen]
        cell = owner * SLOTS + (picked >> np.uint64(58)).astype(np.int64)
        np.minimum.at(least.reshape(-1), cell, (picked & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    seen = least != 0xFFFFFFFF
    out[filled] = np.where(seen, np.maximum(_mixed(least.astype(np.uint64)) & np.uint64(0xFFFF), 1), 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal slots among those that either signature fills; 1 for two without any."""
    filled = (a > 0) | (b > 0)
    equal = ((a == b) & filled).sum(axis=1)
    return np.where(filled.any(axis=1), equal / np.maximum(filled.sum(axis=1), 1), 1.0)


def written_out(signature: np.ndarray) -> list[str]:
    """Signatures as hexadecimal digits."""
    return [row.astype(">u2").tobytes().hex() for row in signature]


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, key, text) such that those of a bucket, guests last, in descending key, are a stretch of
    the documents in descending doc_id, followed by the document after it. Buckets are stretches of ids of about the
    same number of rows; the last one is followed by the first."""
    many_tasks = partitions(docs)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("unnamed"))
    many = min(4 * many_tasks, 4096)
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / many for k in range(1, many)], 1 / (4 * many))
    bounds = np.unique(np.clip(np.array(cuts, np.float64), -9.2e18, 9.2e18)).astype(np.int64)

    @F.pandas_udf("int")
    def bucket(key):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, key.to_numpy()).astype(np.int32))

    firsts = dict(map(tuple, keyed.select("key").groupBy(bucket("key").alias("b")).agg(F.max("key")).collect()))  # a row a bucket
    order = sorted(firsts, reverse=True)
    leads = sorted((firsts[b], order[k - 1]) for k, b in enumerate(order))
    heads = np.array([k for k, _ in leads], np.int64)
    follows = np.array([b for _, b in leads], np.int32)

    @F.pandas_udf("array<int>")
    def buckets(key):
        import pandas as pd

        keys = key.to_numpy()
        own = np.searchsorted(bounds, keys)
        at = np.searchsorted(heads, keys)
        hit = (at < len(heads)) & (heads[np.minimum(at, max(len(heads) - 1, 0))] == keys) if len(heads) else np.zeros(len(keys), bool)
        return pd.Series([[o, follows[a]] if h else [o] for o, a, h in zip(own.tolist(), at.tolist(), hit.tolist(), strict=True)])

    placed = keyed.select("*", F.posexplode(buckets("key")).alias("guest", "bucket"))
    dealt = placed.repartition(many_tasks, "bucket")
    return dealt.sortWithinPartitions("bucket", "guest", F.desc("key"), "unnamed", "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    docs has doc_id and text; other columns are ignored. The next document is the one after in descending doc_id,
    after the last the first; rows of one doc_id follow by text, and null ids come last. The edited text is the text
    with its last floor(n_chars / 2) code points replaced by as many of the first of the next document, or all that it
    has. Null texts are empty; an empty text has an empty fingerprint, which is like another empty one only. Every row
    gets its result, repeated rows too; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0

        def results() -> pa.RecordBatch:
            rows = [(row, after) for row, after in zip(held, held[1:], strict=False) if row[1] == 0]
            own = signatures([r[4] for r in held])
            places = [k for k, row in enumerate(held[:-1]) if row[1] == 0]
            edited = []
            for row, after in rows:
                half = len(row[4]) // 2
                edited.append(row[4][: len(row[4]) - half] + after[4][:half])
            other = signatures(edited)
            mine, following = own[places], own[[k + 1 for k in places]]
            columns = [
                pa.array([None if row[3] else row[2] for row, _ in rows], pa.int64()),
                pa.array([len(row[4]) for row, _ in rows], pa.int64()),
                pa.array([sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array(written_out(mine), pa.string()),
                pa.array(written_out(other), pa.string()),
                pa.array(likeness(mine, other), pa.float64()),
                pa.array(likeness(mine, following), pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in sliced(batches, limit=1 << 20):
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "key", "unnamed", "text")), strict=True):
                held.append(row)
                chars += len(row[4])
                if chars > FLAT_CHARS and len(held) > 1:
                    yield results()
                    held = [row]
                    chars = len(row[4])
        if len(held) > 1:
            yield results()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(docs).select("bucket", "guest", "key", "unnamed", "text").mapInArrow(run, schema)


def op3_fingerprints(spark, sf_dir):
    return fingerprinted(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLE: dict[str, str] = {}
