"""Near-duplicate removal: SimHash candidates, verified by the similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import sliced, texts
from quillspark.llm.components import components
from quillspark.llm.simhash import links, majorities, shingle_hashes
from quillspark.llm.shared import Scratch, gathered, small_batches, written

WIDTH, SIMILARITY = 5, 0.8
#: Bits of a set's parity sketch, and rows of a block: blocks of the rows that share a key are compared two by two.
SKETCH_BITS, BLOCK = 512, 256
#: So many ids of texts that are compared are broadcast, 8 MB.
FEW_IDS = 1_000_000
#: About so many texts of a block of those that meet are compared with about so many others, which are kept meanwhile.
ROWS_MET, HUBS_MET, BLOCK_KEY = 256, 32, ("lead", "kind", "i", "j")
#: With more than so many pairs for each text, so many of each text, or group that is joined, are verified before the rest.
DENSE, ROUNDS = 4, (1, 8, 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def slice_counts(n: int, similarity: float = SIMILARITY) -> list[int]:
    """Into how many slices a set of n shingles is dealt: two to four shingles a slice, four to eight in large sets.

    The count is a step function of n. A set so close above a step that a similar one may be below it is dealt in both
    ways, so similar sets always have a way in common.
    """
    if n == 0:
        return []
    low = 1 << (n.bit_length() - 1)
    count = lambda power: max(1, power // 2 if power <= 64 else 32 if power == 128 else power // 4)
    found = {count(low)}
    if n * similarity < low and low > 1:
        found.add(count(low // 2))
    return sorted(found)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(id, doc_id, same, fp, slices, size, bits) for (id, doc_id, text): a hash of 128 bits of all words, the SimHash of the
    shingles, a hash for each slice of the distinct shingles, of its own SimHash and its number, and how many distinct
    shingles there are, with the parity of those at each of SKETCH_BITS places."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=1 << 20):
            same, hashed, counts, slices, sizes, names, many_distinct, bits = [], [], [], [], [], [], [], []
            for text in texts(batch).to_pylist():
                found = np.array(shingle_hashes(text, width), np.uint64)
                same.append(xxh3_128_digest(b" ".join(text.encode().lower().split())))
                hashed.append(found)
                counts.append(len(found))
                distinct = np.unique(found)
                spread = _mixed(distinct)
                many_distinct.append(len(distinct))
                places = (spread >> np.uint64(40)) % np.uint64(SKETCH_BITS)
                bits.append(np.packbits(np.bincount(places.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1))
                own = 0
                for many in slice_counts(len(distinct)):
                    cell = (spread >> np.uint64(24)) % np.uint64(many)
                    order = np.argsort(cell, kind="stable")
                    filled, size = np.unique(cell, return_counts=True)
                    slices.append(distinct[order])
                    sizes.append(size)
                    names.append(filled + np.uint64(many << 32))
                    own += len(filled)
                slices.append(own)
            numbers = [s for s in slices if isinstance(s, int)]
            parts = [s for s in slices if not isinstance(s, int)]
            fps = majorities(np.concatenate(hashed), np.array(counts)) if hashed else np.zeros(0, np.uint64)
            if parts:
                keys = _mixed(majorities(np.concatenate(parts), np.concatenate(sizes)) ^ _mixed(np.concatenate(names) + np.uint64(1)))
            else:
                keys = np.zeros(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32)
            columns = [
                batch.column("id"), batch.column("doc_id"), pa.array(same, pa.binary()), pa.array(fps.view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64))), pa.array(many_distinct, pa.int32()),
                pa.ListArray.from_arrays(np.arange(len(bits) + 1, dtype=np.int32) * (SKETCH_BITS // 64), pa.array(np.concatenate(bits).view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "doc_id", "same", "fp", "slices", "size", "bits"])

    return docs.mapInArrow(run, "id long, doc_id long, same binary, fp long, slices array<long>, size int, bits array<long>")


def members(kept: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """(key, id, low, high, n): the rows (id, fp, slices) under each key that at least two have, n with the least and the
    greatest of them. Keys stand for slices, for fingerprints, and for each fingerprint together with those of which it
    is the lesser end of a link in the grid join. There are about n rows."""
    fps = scratch.written(kept.select("fp").distinct(), "near-fingerprints", n)
    near = scratch.written(links(fps, scratch), "near-links", n)
    around = near.select("a", F.col("b").alias("fp")).union(near.select("a", F.col("a").alias("fp"))).distinct()
    found = kept.select(F.explode("slices").alias("key"), "id")
    found = found.union(kept.select(F.xxhash64(F.lit("same"), "fp").alias("key"), "id"))
    found = found.union(kept.select("fp", "id").join(around, "fp").select(F.xxhash64(F.lit("near"), "a").alias("key"), "id"))
    ends = found.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).filter("low < high")
    return scratch.written(found.join(scratch.written(ends, "near-keys", n), "key"), "near-members")


def ends_paired(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: each row of members() with the least and the greatest under its key."""
    pairs = rows.select("id", F.explode(F.array("low", "high")).alias("other")).filter("id <> other")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def rest_paired(rows: DataFrame, roots: DataFrame, sketches: DataFrame, similarity: float, scratch: Scratch, n: int) -> DataFrame:
    """(a, b), a < b: all other pairs under a key of members() that may be near and aren't joined yet by roots (node,
    root).

    Keys whose rows are all joined are done. Rows of others (sketches: id, size, bits) are dealt to blocks, and every
    block is compared with itself and with every other one of its key. Sets of a given similarity differ in a bounded
    number of shingles; places whose parity differs are no more than these, and neither is the difference of sizes, so
    no pair that is near is left out.
    """
    left = rows.filter("n > 3 and id <> low and id <> high").select("key", "id")
    left = left.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    left = scratch.written(left, "near-left", n)
    several = left.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two"), F.count("*").alias("n")).filter("one < two")
    several = scratch.written(several.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "near-open", n)
    dealt = left.join(several, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sketches, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = F.struct("own", "id", "root", "size", "bits")
    met = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(row).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            if not len(lists):
                continue
            ends, flat = np.cumsum(np.asarray(lists.value_lengths())), lists.flatten()
            own, ids, root, size = (np.asarray(flat.field(name)) for name in ("own", "id", "root", "size"))
            bits = np.asarray(flat.field("bits").flatten()).view(np.uint64).reshape(len(flat), -1)
            first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, end, i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
                ones = np.arange(at, end)[own[at:end] == i]
                twos = ones if i == j else np.arange(at, end)[own[at:end] == j]
                for some in np.array_split(ones, len(ones) // 32 + 1):
                    x, y = np.nonzero(root[some][:, None] != root[twos])
                    x, y = some[x], twos[y]
                    if i == j:
                        x, y = x[x < y], y[x < y]
                    apart = np.abs(size[x] - size[y])
                    most = _most_apart(size[x].astype(np.int64) + size[y], similarity)
                    x, y, most = x[apart <= most], y[apart <= most], most[apart <= most]
                    near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= most
                    first.append(ids[x[near]])
                    second.append(ids[y[near]])
            x, y = np.concatenate(first), np.concatenate(second)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return met.select("i", "j", "rows").mapInArrow(run, "a long, b long").distinct()


def _most_apart(sizes, similarity: float):
    """How many shingles two sets of so many in all may differ in, if they are near."""
    return sizes * ((1 - similarity) / (1 + similarity)) + 1e-6


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and parity sketches (id, size, bits) don't rule out; no near pair is ruled out."""
    one = sketches.select(F.col("id").alias("a"), F.col("size").alias("m"), F.col("bits").alias("x"))
    two = sketches.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("bits").alias("y"))
    differing = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    most = _most_apart(F.col("m") + F.col("n"), similarity)
    return pairs.join(one, "a").join(two, "b").filter((F.abs(F.col("m") - F.col("n")) <= most) & (differing <= most)).select("a", "b")


def linked(pairs: DataFrame) -> DataFrame:
    """(id, links): in how many of the pairs (a, b) a text is."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))


def aimed(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(hub, row, links) for the pairs (a, b): the text in more pairs (ids: id, links) is the hub, the other the row."""
    one, two = ids.select(F.col("id").alias("a"), F.col("links").alias("m")), ids.select(F.col("id").alias("b"), F.col("links").alias("n"))
    turned = F.col("n") > F.col("m")
    hub, row = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    return pairs.join(one, "a").join(two, "b").select(hub.alias("hub"), row.alias("row"), F.greatest("m", "n").alias("links"))


def leads(rows: DataFrame) -> DataFrame:
    """(row, lead): the most linked hub of each row of aimed()."""
    return rows.groupBy("row").agg(F.max(F.struct("links", "hub")).alias("first")).select("row", F.col("first.hub").alias("lead"))


def met_in_blocks(pairs: DataFrame, ids: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """(lead, kind, i, j, id, others): in which blocks the texts of n pairs (a, b) are compared, with which others.

    Rows are put together by their lead, and hubs of a lead by how many of its rows they meet, in powers of 16: rows that
    meet the same hubs share blocks of about ROWS_MET rows and HUBS_MET hubs. A block has each of its rows and hubs once,
    hubs (without others) first to be kept; so a text goes to fewer places than it has pairs wherever many meet.
    """
    met = scratch.written(aimed(pairs, ids), "near-aimed", n)
    led = scratch.written(met.select("hub", "row").join(leads(met), "row"), "near-led", n)
    hubs = led.groupBy("lead", "hub").agg(F.count("*").alias("met"))
    hubs = scratch.written(hubs.select("lead", "hub", F.floor(F.log2("met") / 4).cast("int").alias("kind")), "near-hubs", n)
    kinds = led.join(hubs, ["lead", "hub"])
    blocks = hubs.groupBy("lead", "kind").agg(F.ceil(F.count("*") / HUBS_MET).cast("int").alias("hub_blocks"))
    rows = kinds.select("lead", "kind", "row").distinct().groupBy("lead", "kind").agg(F.ceil(F.count("*") / ROWS_MET).cast("int").alias("row_blocks"))
    sizes = scratch.written(blocks.join(rows, ["lead", "kind"]), "near-sizes", n)
    i, j = F.pmod(F.xxhash64("row"), F.col("row_blocks")).cast("int"), F.pmod(F.xxhash64("hub"), F.col("hub_blocks")).cast("int")
    dealt = scratch.written(kinds.join(sizes, ["lead", "kind"]).select(*BLOCK_KEY[:2], i.alias("i"), j.alias("j"), "hub", "row"), "near-dealt", n)
    kept = dealt.select(*BLOCK_KEY, F.col("hub").alias("id"), F.array().cast("array<long>").alias("others")).distinct()
    return kept.union(dealt.groupBy(*BLOCK_KEY, F.col("row").alias("id")).agg(F.collect_list("hub").alias("others")))


def verified(pairs: DataFrame, ids: DataFrame, docs: DataFrame, width: int, similarity: float, scratch: Scratch, n: int) -> DataFrame:
    """Those of n pairs (a, b) whose texts' distinct shingles have at least this share of their union in common. ids (id,
    links) has their texts."""
    met = met_in_blocks(pairs, ids, scratch, n)
    ids = ids.select("id")
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids  # else the texts are dealt out by id
    some = scratch.written(docs.join(ids, "id", "left_semi").select("id", "text").dropDuplicates(["id"]), "near-texts")
    found = met.join(some, "id").select(*BLOCK_KEY, "id", "others", "text")
    found = found.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, F.size("others") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in sliced(batches, limit=1 << 20):
            first, second = [], []
            keys = zip(*(batch.column(name).to_pylist() for name in BLOCK_KEY), strict=True)
            for key, own, others, text in zip(keys, batch.column("id").to_pylist(), batch.column("others").to_pylist(), texts(batch).to_pylist(), strict=True):
                if key != block:
                    block, sets = key, {}
                found = np.unique(np.array(shingle_hashes(text, width), np.uint64))
                if not others:
                    sets[own] = found
                for other in others:
                    common = len(np.intersect1d(found, sets[other], assume_unique=True))
                    if common >= similarity * (len(found) + len(sets[other]) - common):
                        first.append(min(own, other))
                        second.append(max(own, other))
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])

    with small_batches(pairs.sparkSession, 100):
        return scratch.written(found.mapInArrow(run, "a long, b long"), "near-verified")


def joined(pairs: DataFrame, known: DataFrame | None, docs: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, root): what is connected by those of the pairs (a, b) that are near, and by the roots known so far.

    While there are many pairs for each text, only some are verified: one for each text, with its most linked one, then
    some for each group that is joined so far, the less linked one of two. Pairs that are joined by then are left out, as
    they connect nothing; all others are verified in the end. So texts of a large group aren't compared with all that they
    share a slice with.
    """
    pairs = pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))
    for several in (*ROUNDS, 0):
        many = pairs.count()
        ids = scratch.written(linked(pairs.select("a", "b")), "near-ids", 2 * many)
        some, dense = pairs.select("a", "b"), several > 0 and many > DENSE * ids.count()
        if dense:
            roots = linked(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
            one, two = roots.select(F.col("id").alias("x"), F.col("links").alias("m")), roots.select(F.col("id").alias("y"), F.col("links").alias("n"))
            row = F.when(F.col("n") > F.col("m"), F.col("x")).otherwise(F.col("y")).alias("row")
            part = F.pmod(F.xxhash64("a", "b"), F.lit(several)).alias("part")
            best = F.max(F.struct(F.greatest("m", "n"), F.least("x", "y"), "a", "b")).alias("best")
            some = pairs.join(one, "x").join(two, "y").groupBy(row, part).agg(best).select("best.a", "best.b")
            some = scratch.written(some, "near-some", many)
        near = verified(some, linked(some) if dense else ids, docs, width, similarity, scratch, some.count())
        if known is not None:
            near = near.union(known.select("node", "root"))
        known = scratch.written(components(near, "near-components"), "near-roots", many)
        if not dense:
            return known
        one, two = known.select(F.col("node").alias("a"), F.col("root").alias("x")), known.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = pairs.select("a", "b").join(some, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
        left = left.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).filter("x <> y")
        pairs = scratch.written(left, "near-apart", many)
    raise AssertionError("the last round isn't dense")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs (doc_id, text and any others) of which one of each group of near-duplicates stays.

    Texts are near if their words (between ASCII white space, A-Z lower-cased) are the same, or if at least
    ``similarity`` of the union of their distinct shingles of ``width`` words is common to both; of fewer words all
    make one shingle. Groups are what is connected by nearness, and the row with the smallest doc_id stays (a null
    doc_id is the largest; among equal ids one of the texts is chosen by its hash).

    Candidates come from SimHash: the fingerprint of the whole text, whose grid join finds at most two differing bits,
    and, as texts of a similarity of 0.8 differ in more, the fingerprints of slices of the shingles. The slices are
    equal in many places in texts that are this near, seldom in others. Rows that share one are first paired with the
    least and the greatest of them, then with all that they aren't joined with by then. Every candidate pair is verified
    by its shingles. Null and empty texts count as the same. Of rows with the same doc_id and text the one with the least
    hash of its other columns stays. Other columns may have any names and are kept. An empty table stays empty.
    """
    own = docs.columns
    docs = docs.withColumn("__id", F.xxhash64("doc_id", "text"))
    named = docs.select(F.col("__id").alias("id"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    first, second = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    with small_batches(docs.sparkSession):
        rows = first.written(sketched(named, width), "near-sketches")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "id")
    firsts = rows.groupBy("same").agg(F.min(order).alias("first")).select("first.id", "first.doc_id")
    n = rows.count()
    firsts = second.written(firsts, "near-firsts", n)
    kept = first.written(rows.join(firsts.select("id"), "id", "left_semi").dropDuplicates(["id"]).select("id", "fp", "slices", "size", "bits"), "near-kept")
    shared = members(kept, first, n)
    sketches = kept.select("id", "size", "bits")
    pairs = second.written(possible(ends_paired(shared), sketches, similarity), "near-pairs", n)
    roots = joined(pairs, None, named, width, similarity, second)
    with small_batches(docs.sparkSession, 200):
        more = second.written(rest_paired(shared, roots, sketches, similarity, first, n), "near-more")
    first.clear()
    if not more.isEmpty():
        roots = joined(more, roots, named, width, similarity, second)
    grouped = firsts.join(roots, F.col("id") == F.col("node"), "left")
    alone = grouped.filter("root is null").select("id")
    best = grouped.filter("root is not null").groupBy("root").agg(F.min(order).alias("first")).select("first.id")
    staying, _ = written(gathered(alone.union(best).withColumnRenamed("id", "__id"), n), "near-staying")
    second.clear()
    others = [c for c in own if c not in ("doc_id", "text")]
    hashed = [c for c, kind in docs.dtypes if c in others and "map<" not in kind and "variant" not in kind]
    kept = docs.join(staying, "__id", "left_semi").select("__id", "doc_id", "text", F.struct(*others, F.lit(0).alias("__")).alias("rest"), F.xxhash64(*hashed, F.lit(0)).alias("h"))
    return kept.groupBy("__id", "doc_id", "text").agg(F.min_by("rest", "h").alias("rest")).select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in own])
