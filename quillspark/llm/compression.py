"""What the compression classifiers share: bounded samples of labelled text and sizes under zstandard dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts are compressed in chunks of so many bytes, so that a long text's own content doesn't replace the dictionary.
CHUNK = 2048
#: Of all hashes so many; a row is drawn if its hash falls under a share of it.
SPACE = 1 << 62
#: Labels whose shares are broadcast; more are joined as Spark sees fit.
LABELS = 1000


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def drawn(rows: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows of each label, the ones with the least hash of ``key``; all of smaller labels. Of rows with an
    equal label and key one is drawn from.

    Distinct keys are counted first, and rows drawn by a share of the hashes that leaves about twice as many as are needed,
    so neither a frequent label nor its repeats meet in one task. Rows with a null label are left out.
    """
    hashed = rows.filter(F.col(label).isNotNull()).withColumn("__hash", F.pmod(F.xxhash64(key), F.lit(SPACE)))
    counts = hashed.select(label, "__hash").distinct().groupBy(label).agg(F.count("*").alias("__n"))
    shares = counts.select(label, (F.least(F.lit(1.0), (F.lit(2.0) * most + 64) / F.col("__n")) * SPACE).alias("__share"))
    few = shares.limit(LABELS + 1).collect()
    if len(few) <= LABELS:
        shares = F.broadcast(rows.sparkSession.createDataFrame(few, shares.schema))
    first = Window.partitionBy(label).orderBy("__hash")
    found = hashed.join(shares, label).filter(F.col("__hash") <= F.col("__share")).dropDuplicates([label, "__hash"])
    return found.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= most).select(*rows.columns)


def piece(text: Column, chars: int) -> Column:
    """A stretch of a text of at most so many characters, whose place depends on the text's hash."""
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(text), room) + 1).cast("int"), F.lit(chars))


def compressor(dictionary, level: int):
    import zstandard

    if dictionary is not None:
        dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def raw_dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None


def chunks(data: bytes, size: int = CHUNK) -> list[bytes]:
    return [data[at : at + size] for at in range(0, len(data), size)]


def total_size(compress, parts: list[bytes]) -> int:
    """Compressed bytes of all parts, each alone."""
    return sum(len(compress(p)) for p in parts)
