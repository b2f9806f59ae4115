"""Interfaces of the models that queries use, and deterministic stand-ins that need no weights.

The stand-ins are labelled as such: they give repeatable numbers of the right kind, not those of a trained network.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import tokens

ENCODED_CHARS = 4000
#: Rows whose vectors, or prompts, a worker holds at once.
ENCODED_ROWS = 512


class Encoder(Protocol):
    """Texts to unit vectors."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    """Continuations of a prompt."""

    def generate(self, prompt: str, n: int, seed: int) -> list[str]: ...


class CompletionScorer(Protocol):
    """How likely texts are after a prompt: the mean log-likelihood of their tokens, higher for likelier ones."""

    def score(self, prompt: str, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=4)
def _made(factory: Callable[..., object], args: tuple) -> object:
    return factory(*args)


@dataclass(frozen=True)
class Loaded:
    """A model that is made where it is first used, and then kept by that worker: what travels with a plan is how to make
    it, not its weights. Its methods are the model's."""

    factory: Callable[..., object]
    args: tuple = ()

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(_made(self.factory, self.args), name)


@dataclass(frozen=True)
class HashingEncoder:
    """Stand-in: words and their three-letter parts hashed to signed dimensions, then scaled to length 1."""

    size: int = 384

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in enumerate(texts):
            words = (text or "")[:ENCODED_CHARS].lower().split()
            for part in [*words, *(w[k : k + 3] for w in words for k in range(max(1, len(w) - 2)))]:
                h = zlib.crc32(part.encode())
                out[row, h % self.size] += 1.0 if h & 0x80000000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


@dataclass(frozen=True)
class EchoGenerator:
    """Stand-in: recombines halves of the lines of its prompt, chosen by a seeded hash."""

    def generate(self, prompt: str, n: int, seed: int) -> list[str]:
        lines = [line.split() for line in prompt.splitlines() if len(line.split()) >= 4]
        out = []
        for k in range(n):
            if not lines:
                return [""] * n
            a, b = (lines[zlib.crc32(f"{seed}:{k}:{side}:{len(prompt)}".encode()) % len(lines)] for side in "ab")
            out.append(" ".join(a[: len(a) // 2 + 1] + b[len(b) // 2 :]))
        return out


@dataclass(frozen=True)
class PromptScorer:
    """Stand-in: words by their smoothed frequency in the prompt."""

    def score(self, prompt: str, texts: list[str]) -> np.ndarray:
        known = Counter(prompt.lower().split())
        total, kinds = sum(known.values()), len(known) + 1
        words = [(text or "").lower().split() for text in texts]
        return np.array([sum(log((known[w] + 0.5) / (total + 0.5 * kinds)) for w in ws) / max(1, len(ws)) for ws in words])


def encoded(df: DataFrame, text: str, encoder: Encoder, name: str = "embedding") -> DataFrame:
    """Adds a vector for each row; equal texts are encoded once in each piece of ENCODED_ROWS rows."""

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for piece in pieces(batches):
            codes = piece.fill_null("").dictionary_encode()
            found = np.asarray(encoder.encode(codes.dictionary.to_pylist()), np.float32)[codes.indices.to_numpy()]
            ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return df.withColumn(name, vectors(F.col(text)))


def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches in pieces of at most ENCODED_ROWS rows, so that a worker's vectors don't grow with Spark's batches."""
    for batch in batches:
        for at in range(0, len(batch), ENCODED_ROWS):
            yield batch.slice(at, ENCODED_ROWS)


def compressed_length(text: str | Column) -> Column:
    """Bytes of a text under zlib; a blank text has none."""

    @F.pandas_udf("int")
    def length(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: len(zlib.compress(t.encode())) if t.strip() else 0).astype("int32")

    return length(text)


@dataclass(frozen=True)
class BigramScorer:
    """Stand-in for a language model's loss: bigrams of tokens interpolated with single ones, from counted tables."""

    unigrams: DataFrame
    bigrams: DataFrame
    total: int
    vocabulary: int
    mix: float = 0.7

    @classmethod
    def fitted(cls, df: DataFrame, text: str) -> BigramScorer:
        words = df.select(F.concat(F.array(F.lit("<s>")), tokens(F.col(text))).alias("w"))
        one = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n1"))
        pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(F.get(F.col("w"), k - 1).alias("before"), F.get(F.col("w"), k).alias("word")))
        two = words.filter(F.size("w") > 1).select(F.explode(pairs).alias("p")).groupBy("p.before", "p.word").agg(F.count("*").alias("n2"))
        total, vocabulary = one.filter("word <> '<s>'").agg(F.coalesce(F.sum("n1"), F.lit(0)), F.count("*")).first()
        return cls(one, two, total, vocabulary)

    def perplexities(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, ppl) of rows with distinct keys: exp of the mean loss of the tokens; a text without tokens is left out."""
        words = df.select(key, F.concat(F.array(F.lit("<s>")), tokens(F.col(text))).alias("w"))
        pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(F.get(F.col("w"), k - 1).alias("before"), F.get(F.col("w"), k).alias("word")))
        each = words.filter(F.size("w") > 1).select(key, F.explode(pairs).alias("p")).select(key, "p.before", "p.word")
        before = self.unigrams.select(F.col("word").alias("before"), F.col("n1").alias("nb"))
        joined = each.join(self.bigrams, ["before", "word"], "left").join(self.unigrams, "word", "left").join(before, "before", "left")
        single = (F.coalesce("n1", F.lit(0)) + 1.0) / (self.total + self.vocabulary + 1.0)
        double = F.coalesce(F.col("n2") / F.col("nb"), F.lit(0.0))
        return joined.groupBy(key).agg(F.exp(-F.avg(F.log(self.mix * double + (1 - self.mix) * single))).alias("ppl"))


def passage(text: Column, prefix: str = "Research direction: ") -> Column:
    return F.concat(F.lit(prefix), F.trim(text))
