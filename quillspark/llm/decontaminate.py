"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import written
from quillspark.sources.tables import table

#: Masks over a window of words: where they have 0, words may differ.
MASKS = ("1110110011", "1101011011", "1101110101")
SPAN = len(MASKS[0])
#: A benchmark text is verified in cells of so many words, each seen with so many words on either side.
CELL, MARGIN = 32, 16
VIEW = CELL + SPAN + 2 * MARGIN
#: A word in common counts 1, a differing one so much; an overlap whose best stretch counts LEAST is a leak.
DIFFERS, LEAST = -2, 8
#: Items shorter than the span must match in all words, and have so many at least.
SHORTEST = 5
#: Seeds that are broadcast at once, about 20 MB; a larger benchmark goes over the documents in several blocks.
BLOCK_SEEDS = 250_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.split(F.regexp_replace(lowered, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"[^\p{L}\p{N}]+")


def _seed(mask: str, array: str, at: Column) -> Column:
    chosen = [F.get(F.col(array), at + k) for k, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(F.lit(mask), *chosen)


def _view(array: str, start: Column) -> Column:
    """The words of a view that starts at a place, which may lie before the first word."""
    first = F.greatest(start, F.lit(0))
    return F.slice(F.col(array), first + 1, F.greatest(start + VIEW - first, F.lit(0)))


def seeded(items: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """Benchmark texts (item_id, words) as (seed, item_id, place, mask, before), with the seed of the place before in the
    same cell, and the masks in use: short items add their own."""
    long = F.size("words") >= SPAN
    lengths = items.filter(~long & (F.size("words") >= SHORTEST)).select(F.size("words").alias("n")).distinct()
    short = tuple("1" * n for n in sorted(r.n for r in lengths.collect()))  # at most SPAN - SHORTEST
    placed = items.select("item_id", "words", F.posexplode_outer("words").alias("place", "__word"))
    inside = F.col("place") % CELL != 0
    parts = [
        placed.filter(long & (F.col("place") + SPAN <= F.size("words")) if mask in MASKS else (F.size("words") == len(mask)) & (F.col("place") == 0))
        .select(_seed(mask, "words", F.col("place")).alias("seed"), "item_id", "place", F.lit(k).alias("mask"), F.when(inside, _seed(mask, "words", F.col("place") - 1)).alias("before"))
        for k, mask in enumerate(MASKS + short)
    ]
    seeds = parts[0]
    for part in parts[1:]:
        seeds = seeds.union(part)
    return seeds, MASKS + short


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, score) of documents that hold a benchmark text or a stretch of it.

    docs has doc_id and text, benchmark has item_id and text; other columns are ignored. Every window of SPAN words of
    both sides is hashed under each mask, so windows meet although words at the masks' zeros differ. Where they meet,
    the two texts are laid over each other and compared word by word around the hit: a word in common counts 1, a
    differing one DIFFERS, and the best stretch must count LEAST (an item shorter than the span matches whole, with as
    many as its words). score is the best of a document and item. Words are lower-cased letters and digits.

    Null or empty texts hold nothing and are nobody's leak; items of fewer than SHORTEST words are too short to tell.
    Documents are told apart by doc_id, which may be null, and text: repeated rows give one result. Items with the
    same text give a result each, those with a null id one together. Either table may be empty. Seeds are broadcast in blocks of bounded size, so the
    documents are never shuffled, and what is shuffled are views of VIEW words around distinct hits.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).distinct()
    items, _ = written(items, "leak-items")
    seeds, masks = seeded(items)
    seeds, _ = written(seeds.distinct(), "leak-seeds")
    blocks = max(1, ceil(seeds.count() / BLOCK_SEEDS))

    known = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    at = known.select("*", F.posexplode_outer("words").alias("pos", "__word"))
    hashes = F.array(*[F.when(F.col("pos") + len(m) <= F.size("words"), _seed(m, "words", F.col("pos"))) for m in masks])
    probes = at.select("doc_id", "text_hash", "words", "pos", F.explode_outer(hashes).alias("seed")).filter("seed is not null")
    shift = F.col("pos") - F.col("place")
    cell = F.floor(F.col("place") / CELL).cast("int")
    # Where the words before meet as well, they lay the texts over each other in the same way, and their hit stands for
    # this one: texts that repeat themselves meet in many places, but in few ways.
    previous = F.coalesce(*[F.when(F.col("mask") == k, _seed(m, "words", F.col("pos") - 1)) for k, m in enumerate(masks)])
    first = F.col("before").isNull() | (F.col("pos") == 0) | (F.col("before") != previous)
    found = None
    for block in range(blocks):
        # Blocks are dealt by whole rows, so a seed that an item has many times is in several of them.
        some = seeds.filter(F.pmod(F.xxhash64(*seeds.columns), F.lit(blocks)) == block)
        hits = probes.join(F.broadcast(some), "seed").filter(first).select(
            "doc_id", "text_hash", "item_id", shift.alias("shift"), cell.alias("cell"), _view("words", shift + cell * CELL - MARGIN).alias("seen")
        )
        found = hits.distinct() if found is None else found.union(hits.distinct())
    hits, _ = written(found.distinct() if blocks > 1 else found, "leak-hits")

    cells = items.select("item_id", F.size("words").alias("n"), "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / CELL).cast("int"))).alias("cell"))
    start = F.col("cell") * CELL - MARGIN
    cells = cells.select(F.col("item_id").alias("item"), "n", F.col("cell").alias("of"), _view("words", start).alias("wanted"))
    at_doc, at_item = F.greatest(-(F.col("shift") + start), F.lit(0)), F.greatest(-start, F.lit(0))
    worth = F.transform(
        F.sequence(F.lit(0), F.lit(VIEW - 1)),
        lambda k: F.when(F.get(F.col("seen"), k - at_doc) == F.get(F.col("wanted"), k - at_item), 1).otherwise(DIFFERS),
    )
    best = F.aggregate(
        worth,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, x: F.struct(F.greatest(s.now + x, F.lit(0)).alias("now"), F.greatest(s.best, s.now + x).alias("best")),
        lambda s: s.best,
    )
    same = hits["item_id"].eqNullSafe(cells["item"]) & (hits["cell"] == cells["of"])
    verified = hits.join(cells, same).select("doc_id", "text_hash", "item_id", "n", best.alias("score"))
    leaked = verified.filter(F.col("score") >= F.least(F.lit(LEAST), F.col("n")))
    return leaked.groupBy("doc_id", "text_hash", "item_id").agg(F.max("score").alias("score"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark text, with all their columns; null texts stay. See leaks()."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    bad, _ = written(bad, "leak-documents")
    same = (F.xxhash64(docs["text"]) == bad["__hash"]) & docs["doc_id"].eqNullSafe(bad["__id"])
    return docs.join(bad, same, "left_anti")


def op6_decontaminate(spark, sf_dir):
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _key(mask: str) -> str:
    return " || ' ' || ".join([f"'{mask}'", *(f"w[p + {k + 1}]" for k, bit in enumerate(mask) if bit == "1")])


_WORDS = r"string_split_regex(regexp_replace(lower(coalesce(text, '')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '[^\p{L}\p{N}]+') as w"
_ALL = [*MASKS, *("1" * n for n in range(SHORTEST, SPAN))]
_ITEM_KEYS = " union all ".join(
    f"select item_id, p, {_key(m)} as k from ip where " + (f"len(w) >= {SPAN} and p + {SPAN} <= len(w)" if m in MASKS else f"len(w) = {len(m)} and p = 0") for m in _ALL
)
_DOC_KEYS = " union all ".join(f"select doc_id, p, {_key(m)} as k from dp where p + {len(m)} <= len(w)" for m in _ALL)
_SQL = f"""
with i as (select item_id, {_WORDS} from benchmark),
d as (select doc_id, {_WORDS} from documents where text is not null),
ip as (select item_id, w, unnest(range(len(w))) as p from i),
dp as (select doc_id, w, unnest(range(len(w))) as p from d),
ik as ({_ITEM_KEYS}),
dk as ({_DOC_KEYS}),
h as (select distinct doc_id, item_id, dk.p - ik.p as shift, ik.p // {CELL} as cell from dk join ik using (k)),
v as (select h.*, unnest(range({VIEW})) + cell * {CELL} - {MARGIN} as q from h),
c as (select v.*, len(i.w) as n,
        case when q >= 0 and q + shift >= 0 and q < len(i.w) and q + shift < len(d.w) and i.w[q + 1] = d.w[q + shift + 1] then 1 else {DIFFERS} end as x
      from v join i using (item_id) join d using (doc_id)),
s as (select *, sum(x) over (partition by doc_id, item_id, shift, cell order by q) as upto from c),
m as (select *, least(0, coalesce(min(upto) over (partition by doc_id, item_id, shift, cell order by q rows between unbounded preceding and 1 preceding), 0)) as low from s),
b as (select doc_id, item_id, shift, cell, n, max(upto - low) as score from m group by all)
select doc_id, item_id, max(score)::int as score from b where score >= least({LEAST}, n) group by all
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLE = {"op6_decontaminate": _SQL}
