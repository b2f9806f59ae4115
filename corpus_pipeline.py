"""From documents to token files: language, near-duplicates, benchmark leaks, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.decontaminate import decontaminated
from quillspark.llm.language import Languages, identified
from quillspark.llm.mixing import emitted, mix_sources
from quillspark.llm.neardup import near_duplicates
from quillspark.llm.shared import new_path, removed, shuffles_freed, word_count
from quillspark.llm.tokens import checksums, public_vocabulary, write_tokens
from quillspark.sources.tables import table


def _packed(docs: DataFrame) -> list[Column]:
    """Each row's own columns in one, so that no name of theirs can meet one that an operator adds."""
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the languages are learned from a bounded sample of the same table.

    Texts that are null, empty or without a letter have no language and go; long texts count whole; texts whose best two
    languages are close or tie go. Repeated rows share their fate. Columns of any names stay as they are; an empty table
    stays empty.
    """
    # Other columns go under names of their own, so that none meets one that is added, and texts go to Python once.
    apart = {c: c if c == "text" else f"own{k}" for k, c in enumerate(docs.columns)}
    judged = identified(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in apart.items()]), Languages.learned(docs))
    return judged.filter("not rejected").select(*[F.col(name).alias(c) for c, name in apart.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8.

    Null, empty and blank texts are one group. The least doc_id stays, null last; repeated rows collapse to one; long texts
    are compared whole. Columns of any names stay; an empty table stays empty.
    """
    return near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts hold none and stay. Rows with the same doc_id and text share their fate. Long texts are searched
    whole. Columns of any names stay; an empty table, or benchmark, changes nothing.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken, none more than twice.

    A null source is the last one. Null and empty texts have size 0 and are drawn like others; ties and repeated rows count
    one by one. Columns of any names stay as they are; an empty table stays empty.
    """
    sized = docs.select("doc_id", "source", word_count(docs["text"]).alias("words"), *_packed(docs))
    return emitted(mix_sources(sized, "words")).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and doc_id, start, n_tokens, ids_crc32 of each document as read back from them.

    Null and empty texts have the end id alone; long texts are encoded whole; a null doc_id comes first, and each of
    repeated rows has its ids. Other columns are ignored; an empty table gives no row.
    """
    path = new_path(spark, "pipeline-tokens")
    write_tokens(docs, path, public_vocabulary())
    return checksums(spark, path)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL expresses neither compression nor SimHash nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with shuffles_freed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
