"""The best cosine of each vector against a set of others, within cells, without emitting pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of one side that meet the other's in one task.
BLOCK = 4096
#: Cosines that are held at once: as many rows of one side as fit, against all of the other's block.
PRODUCT = 1 << 19


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    values = np.asarray(column.flatten(), dtype=np.float64)
    return values.reshape(rows, -1) if rows else np.zeros((0, 1))


def best_of_products(asked: np.ndarray, known: np.ndarray, ranks: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
    """For each k that any rank reaches, the largest product of each asked vector with a known one of at most that rank."""
    order = np.argsort(ranks, kind="stable")
    firsts = {k: n for k in ks if (n := int(np.searchsorted(ranks[order], k, side="right")))}
    best = {k: np.empty(len(asked)) for k in firsts}
    known, strip = known[order].T, max(1, PRODUCT // len(order))
    for at in range(0, len(asked), strip):
        products = asked[at : at + strip] @ known
        for k, n in firsts.items():
            products[:, :n].max(axis=1, out=best[k][at : at + strip])
    return best


def best_similarity(left: DataFrame, right: DataFrame, cell: str, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(cell, key, best): for each row of left the largest dot product with a row of right in the same cell; rows of
    cells without any of right are left out."""
    return best_at_each_k(left, right.withColumn("__rank", F.lit(0)), cell, [0], key, vector, "__rank").drop("k")


def best_at_each_k(left: DataFrame, right: DataFrame, cell: str, ks: list[int], key: str = "id", vector: str = "embedding", rank: str = "rank") -> DataFrame:
    """(cell, key, k, best): the same against the rows of right whose rank is at most k, for each k.

    Both sides are cut into stretches of about BLOCK vectors within their cell. Each pair of stretches is one group, a
    product of two packed matrices that keeps the best of each left row for each k; no pair of rows is ever emitted, no
    cell meets in one task, every product is made once, and a final maximum goes over the stretches.
    """
    right = right.filter(F.col(rank) <= max(ks))
    hashed = F.xxhash64(key)
    sizes = lambda df, name: df.groupBy(F.col(cell).alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counts = sizes(right, "blocks").join(sizes(left, "stretches"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    refs = right.select(F.col(cell).alias("cell"), vector, F.col(rank).cast("long").alias("rank"), hashed.alias("h")).join(counts, "cell")
    refs = refs.select("cell", vector, "rank", F.pmod("h", "blocks").cast("int").alias("block"), every("stretches").alias("stretch"))
    ask = left.select(F.col(cell).alias("cell"), F.col(key).alias("key"), vector, hashed.alias("h")).join(counts, "cell")
    ask = ask.select("cell", "key", vector, F.pmod("h", "stretches").cast("int").alias("stretch"), every("blocks").alias("block"))
    kind = left.schema[key].dataType.simpleString()
    place = left.schema[cell].dataType.simpleString()

    def multiply(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        cells, keys, out = mine.column("cell"), mine.column("key"), []
        if mine.num_rows and theirs.num_rows:
            out = list(best_of_products(_matrix(mine.column(vector)), _matrix(theirs.column(vector)), np.asarray(theirs.column("rank")), ks).items())
        parts = [pa.table({"cell": cells, "key": keys, "k": pa.array(np.full(len(best), k, np.int32)), "best": pa.array(best)}) for k, best in out]
        none = pa.table({"cell": cells.slice(0, 0), "key": keys.slice(0, 0), "k": pa.array([], pa.int32()), "best": pa.array([], pa.float64())})
        return pa.concat_tables(parts or [none])

    joined = ask.groupBy("cell", "stretch", "block").cogroup(refs.groupBy("cell", "stretch", "block"))
    partial = joined.applyInArrow(multiply, f"cell {place}, key {kind}, k int, best double")
    return partial.groupBy("cell", "key", "k").agg(F.max("best").alias("best"))


def dot(a, b):
    """The dot product of two array columns, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scored_against(df: DataFrame, vector: str, centre: np.ndarray, name: str = "score") -> DataFrame:
    """Adds the dot product with one small vector, which goes along with the plan."""
    return df.withColumn(name, dot(F.col(vector), F.array(*[F.lit(float(x)) for x in centre])))


def centroid(df: DataFrame, vector: str, epsilon: float = 1e-9) -> np.ndarray:
    """The mean vector at length 1; sums are aggregated by dimension, a row for each."""
    sums = df.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    if not sums:
        return np.zeros(0)
    mean = np.array([r.m for r in sorted(sums)])
    return mean / (np.linalg.norm(mean) + epsilon)


def kept_apart(df: DataFrame, by: list[str], order: str, text: str, key: str, vector: str, threshold: float = 0.85) -> DataFrame:
    """The rows of each group that are, in order, no near-duplicate of one kept before: another key, and a smaller cosine
    than the threshold. The decision is sequential by nature, so a group is one task; groups are a model's list for a
    year, of at most some hundred rows."""
    columns = df.columns
    schema = df.schema

    def greedy(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        vectors, keys = _matrix(rows.column(vector)), rows.column(key).to_pylist()
        kept: list[int] = []
        seen: set = set()
        for k, name in enumerate(keys):
            if not name or name in seen:
                continue
            if kept and float((vectors[kept] @ vectors[k]).max()) >= threshold:
                continue
            kept.append(k)
            seen.add(name)
        return rows.take(kept).select(columns)

    return df.groupBy(*by).applyInArrow(greedy, schema)

