"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import partitions, word_count, written
from quillspark.sources.tables import table

#: Weights of the sources in code-point order, repeating; null is the last source.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix has this many times the words of its input.
SHARE = 1.5
#: No source and no document is taken more often than this.
MOST = 2.0
SEED = "mix"


def mix_sources(
    docs: DataFrame, size: str = "size", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED
) -> DataFrame:
    """Adds source_size, target and copies to documents that have doc_id, source and a column of sizes.

    The sources' targets share ``share`` times all sizes by weight, up to ``most`` times their own size; what is above
    goes to the others by weight. Within a source every document expects target/source_size copies. The documents are
    taken in order of (size, doc_id), their expected copies are summed up, one offset for the source is added, and a
    document is emitted once for each integer that its interval crosses; so the order stratifies the sample by size.

    The prefix sum is distributed: one range sort deals rows of all sources over all tasks, however large a source is,
    and what is summed over tasks has one row for each task and source. Ties in (size, doc_id) are broken by a hash of
    the row; repeated rows count one by one. Null source: the last source. Null doc_id sorts first. Null size: 0.
    An empty table gives an empty one. Extra columns are kept, but columns named source_size, target or copies are
    replaced. Reruns give the same rows.
    """
    if most < share:
        raise ValueError("the shares can't be met: most is below share")
    docs = docs.drop("source_size", "target", "copies")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumns(
        {
            "__key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")),
            "__size": F.coalesce(F.col(size), F.lit(0)).cast("long"),
            "__tie": F.xxhash64(*plain),
        }
    )
    order = [F.col("__key"), F.col("__size"), F.col("doc_id"), F.col("__tie")]
    ranged = keyed.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    rows, _ = written(ranged.drop("__tie").withColumn("__place", F.monotonically_increasing_id()), "mix-rows")
    rows = rows.withColumn("__task", F.shiftright("__place", 33))

    parts = rows.groupBy("__key", "__task").agg(
        F.count("*").alias("__n"), F.min("__place").alias("__first"), F.sum("__size").alias("__words")
    )
    parts, _ = written(parts, "mix-parts")
    before = Window.partitionBy("__key").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))

    sources = parts.groupBy("__key").agg(F.sum("__words").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sources.withColumn(
        "__w", F.element_at(cycle, ((F.row_number().over(Window.orderBy("__key")) - 1) % len(weights) + 1).cast("int"))
    )
    # The level to which the sources fill: the most that is left for each weight, over all ways to cap the first ones.
    cap = F.lit(most) * F.col("source_size")
    filled = Window.orderBy(cap / F.col("__w"), "__key")
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(
        F.sum(cap).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    open_weight = F.sum("__w").over(filled.rowsBetween(0, Window.unboundedFollowing))
    targets = weighted.withColumn("__level", left / open_weight).select(
        "__key",
        "source_size",
        F.least(F.col("__w") * F.max("__level").over(whole), cap).alias("target"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "__key").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("__u"),
    )
    facts, _ = written(bases.join(targets, "__key").select("__key", "__task", "__first", "__base", "source_size", "target", "__u"), "mix-facts")

    rank = F.col("__base") + F.col("__place") - F.col("__first")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((rank + 1) * rate + F.col("__u")) - F.floor(rank * rate + F.col("__u"))
    return (
        rows.join(facts, ["__key", "__task"])
        .withColumn("copies", crossed.cast("long"))
        .drop("__key", "__task", "__place", "__size", "__first", "__base", "__u")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as its copies say, without the columns that mixing added."""
    repeats = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return mixed.withColumn("__copy", repeats).drop("__copy", "copies", "source_size", "target")


def op8_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_SQL = r"""
with d as (
  select doc_id, coalesce('s' || source, '~') as k, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
s as (select k, sum(size)::bigint as source_size from d group by k),
w as (select *, ([3.0::double, 1.0::double, 2.0::double])[(row_number() over (order by k) - 1) % 3 + 1] as w from s),
l as (select *, (1.5::double * sum(source_size) over () -
        coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / w, k rows between unbounded preceding and 1 preceding), 0)) /
        sum(w) over (order by 2.0::double * source_size / w, k rows between current row and unbounded following) as level
      from w),
t as (select k, source_size, least(w * max(level) over (), 2.0::double * source_size) as target,
        ('0x' || substr(md5('mix:' || k), 1, 8))::bigint / 4294967296.0::double as u from l),
r as (select d.*, source_size, target, u, row_number() over (partition by k order by size, doc_id) - 1 as rnk,
        case when source_size > 0 then target / source_size else 0 end as rate from d join t using (k))
select doc_id, size, source_size, target,
  size * (floor((rnk + 1) * rate + u) - floor(rnk * rate + u))::bigint as taken
from r
"""

QUERIES = {"op8_mixing": op8_mixing}
ORACLE = {"op8_mixing": _SQL}
