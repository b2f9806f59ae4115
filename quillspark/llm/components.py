"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import gathered, removed, written

#: No graph of fewer than 2**MOST_ROUNDS nodes takes more rounds.
MOST_ROUNDS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """Links u, v with the least of u and all its neighbours, ``m``. The least is summed up before it is joined, so a
    hub's links stay dealt out as the join can split them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_least(edges)
    rows = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
    return found.select(rows.alias("e")).select("e.u", "e.v").filter("u <> v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the least node reachable.

    Alternates large-star and small-star steps: each round replaces links by links to lesser neighbours, until only
    stars are left; their number never grows. Each round is a table in the shared folder. Links may be repeated, in
    either direction and from a node to itself; such nodes alone and nulls are left out. No link gives an empty table.
    """
    spark = links.sparkSession
    start = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, path = written(start.filter("u <> v").distinct(), name)
    seen = None
    for _ in range(MOST_ROUNDS):
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        starred, between = written(gathered(_large_star(edges), state[0]), name)
        edges, after = written(gathered(_small_star(starred), state[0]), name)
        removed(spark, path, between)
        path = after
    raise RuntimeError("the components did not settle")
