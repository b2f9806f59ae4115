"""SimHash fingerprints and the groups that they link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import sliced, texts
from quillspark.llm.components import components
from quillspark.llm.shared import Scratch, written
from quillspark.sources.tables import table

SEED = 42
#: A grid cell of up to so many fingerprints is compared as it is; those of larger ones go to the finest grid.
CELL_MOST = 32
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float64)


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words, repeats included; of all words if there are fewer; none for no word."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxh64_intdigest(b" ".join(run), SEED) for run in zip(*(words[k:] for k in range(width)), strict=False)]


#: Stretches whose bits are summed at once, so that their sums stay small.
_AT_ONCE = 2048


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each stretch of ``counts`` hashes the 64 bits that are set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(counts)
    for at in range(0, len(counts), _AT_ONCE):
        some = counts[at : at + _AT_ONCE]
        first = int(ends[at] - some[0])
        octets = hashes[first : first + int(some.sum())].astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(octets) < 64 * len(some):  # short stretches: sum their bits as they are
            filled = np.flatnonzero(some)
            starts = (np.cumsum(some) - some)[filled]
            sums = np.zeros((len(some), 64), np.int64)
            if len(filled):
                sums[filled] = np.add.reduceat(np.unpackbits(octets, axis=1), starts, axis=0, dtype=np.int64)
        else:  # long ones: sum the bits of the values that each octet has
            owner = np.repeat(np.arange(len(some)), some) * 256
            values = (np.bincount(owner + octets[:, k], minlength=256 * len(some)).reshape(-1, 256) @ _BITS for k in range(8))
            sums = np.concatenate(list(values), axis=1)
        over = np.packbits(2 * sums > some[:, None], axis=1)
        out[at : at + _AT_ONCE] = over.view(">u8")[:, 0].astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text over its word shingles, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=1 << 20):
            found = [shingle_hashes(t, width) for t in texts(batch).to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((h for hashes in found for h in hashes), np.uint64, int(counts.sum()))
            fps = majorities(flat, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The number of set bits in each of 16 segments of four bits, packed into the four bits of the segment."""
    ones = F.lit(0x5555555555555555)
    odd, even = fp.bitwiseAND(ones), F.shiftrightunsigned(fp, 1).bitwiseAND(ones)
    pairs = F.shiftleft(odd.bitwiseAND(even), 1).bitwiseOR(odd.bitwiseXOR(even))
    low = F.lit(0x3333333333333333)
    return pairs.bitwiseAND(low) + F.shiftrightunsigned(pairs, 2).bitwiseAND(low)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def grid_cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): the grid points within Manhattan distance 1 of a fingerprint's embedding.

    Two embeddings at distance 2 or less have such a point in common, as one lies on a shortest path between them.
    """
    at = F.col("at")
    counts = [F.shiftrightunsigned(at, 4 * k).bitwiseAND(F.lit(15)) for k in range(16)]
    steps = [F.lit(1 << 4 * k) for k in range(16)]
    ups = [F.when(c < 4, at + s) for c, s in zip(counts, steps, strict=True)]
    downs = [F.when(c > 0, at - s) for c, s in zip(counts, steps, strict=True)]
    embedded = fps.select("fp", popcounts(F.col("fp")).alias("at"))
    return embedded.select(F.explode(F.array(at, *ups, *downs)).alias("cell"), "fp").filter("cell is not null")


def links(fps: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(a, b), a < b: links that join all distinct fingerprints at 2 or fewer differing bits, directly or by way of
    others that are as near.

    The segments' bit counts embed a fingerprint; the Manhattan distance of embeddings is at most the number of
    differing bits, so a grid join at distance 2 loses no pair, and each candidate is verified bit by bit. A cell with
    more than CELL_MOST fingerprints isn't compared pair by pair: its fingerprints go to the finest grid, of one-bit
    segments, where the points within distance 1 are the one-bit changes. Whoever meets there differs from the point
    in one bit at most, 65 fingerprints at most meet, and all are linked to the least of them. The links are read from
    intermediate tables, which are the caller's to delete if it gives a scratch.
    """
    scratch = scratch or Scratch(fps.sparkSession)
    cells = grid_cells(fps)
    counts = scratch.written(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-cells")
    shared = scratch.written(cells.join(counts, "cell"), "simhash-shared")
    small = shared.filter(F.col("n") <= CELL_MOST).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.flatten(
        F.transform(
            "fps",
            lambda x: F.transform(
                F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= 2)),
                lambda y: F.struct(x.alias("a"), y.alias("b")),
            ),
        )
    )
    compared = small.select(F.explode(near).alias("e")).select("e.a", "e.b").distinct()

    crowded = shared.filter(F.col("n") > CELL_MOST).select("fp").distinct()
    fp = F.col("fp")
    points = F.explode(F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)]))
    met = crowded.select(points.alias("point"), "fp").groupBy("point").agg(F.collect_list("fp").alias("fps"))
    least = F.array_min("fps")
    stars = met.filter(F.size("fps") > 1).select(least.alias("a"), F.explode("fps").alias("b")).filter("a < b").distinct()
    return compared.union(stars)


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for each row of docs (doc_id, text).

    Fingerprints link at 2 or fewer differing bits; component_id is the smallest doc_id reachable over links, also
    between rows of one fingerprint. Null and empty texts have the fingerprint zero, which links like any other. Rows
    may repeat, also with one doc_id and different texts; each gets its row. A null doc_id is never the smallest; a
    component of null ids alone has a null component_id. An empty table gives an empty one; other columns are ignored.
    """
    found, _ = written(fingerprints(docs, width), "simhash-fingerprints")
    distinct, _ = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots, _ = written(components(links(distinct.select("fp")), "simhash-components"), "simhash-roots")
    linked = roots.withColumnRenamed("node", "fp").join(distinct, "fp")
    named, _ = written(
        distinct.join(linked.select("fp", "root"), "fp", "left")
        .join(linked.groupBy("root").agg(F.min("least").alias("of_root")), "root", "left")
        .select("fp", F.coalesce("of_root", "least").alias("component_id")),
        "simhash-named",
    )
    return found.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash": op4_simhash}
ORACLE: dict[str, str] = {}
