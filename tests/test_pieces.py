"""Models at work get few rows at a time, whatever the size of Spark's batches."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions.models import encoded
from quillspark.operators.classify import classified
from quillspark.operators.generate import answered


class Few:
    def encode(self, texts):
        if len(texts) > 512:
            raise MemoryError(f"{len(texts)} texts at once")
        return np.array([[1.0, len(t), t.count("x")] for t in texts], np.float32)


class Telling:
    def generate(self, prompt, n, seed):
        return [f"{prompt} {seed} {k}" for k in range(n)]


def _texts(spark, n=3000):
    return spark.range(n, numPartitions=1).select("id", F.expr("case when id % 7 = 0 then null else repeat('x', id % 11) || id end").alias("t"))


def test_encoded_in_pieces(spark):
    rows = encoded(_texts(spark), "t", Few()).collect()
    assert len(rows) == 3000 and all(list(r.embedding) == [1.0, len(r.t or ""), (r.t or "").count("x")] for r in rows)


def test_classified_in_pieces(spark):
    rows = classified(_texts(spark), "t", Few()).collect()
    assert len(rows) == 3000 and all((r.label, r.confidence) == ("subject", 0.0) for r in rows if r.t is None)


def test_answered_in_pieces(spark):
    asked = spark.range(1500, numPartitions=1).select(F.concat(F.lit("p"), "id").alias("prompt"), "id", (F.col("id") % 3).cast("int").alias("attempt"))
    got = {(r.id, r.attempt, r.raw) for r in answered(asked, Telling(), 2, 40).collect()}
    assert got == {(k, k % 3 + j, f"p{k} {40 + k % 3} {j}") for k in range(1500) for j in range(2)}
