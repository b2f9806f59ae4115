"""Models at work: lists of directions from prompts that tell what is listed already, lists at one go, extraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.directions import clamped, direction_key, generated_list, parsed_direction, prompt_style, rejection, subjectness
from quillspark.functions.lines import polished
from quillspark.functions.models import ENCODED_ROWS, CompletionScorer, Encoder, Generator
from quillspark.operators.forecast import extraction_prompt, prompt_for
from quillspark.sources.tables import settled

LISTS = "model string, target_year int, place int, text string, key string, score double"


def answered(df: DataFrame, generator: Generator, n: int, seed: int = 42) -> DataFrame:
    """df (prompt and any others) with a row for each of n answers: attempt (from 0, or on from a column of that name) and
    raw. Prompts are dealt out, and answered in pieces of ENCODED_ROWS; a model is held by its worker (see functions.models.Loaded)."""
    keyed = df if "attempt" in df.columns else df.withColumn("attempt", F.lit(0))
    schema = keyed.withColumn("raw", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED_ROWS):
                piece = batch.slice(at, ENCODED_ROWS)
                asked = zip(piece.column("prompt").to_pylist(), piece.column("attempt").to_pylist(), strict=True)
                raw = [text for prompt, attempt in asked for text in generator.generate(prompt, n, seed + int(attempt))]
                rows = piece.take(pa.array(np.repeat(np.arange(piece.num_rows), n)))
                made = {"attempt": pc.add(rows.column("attempt"), pa.array(np.tile(np.arange(n), piece.num_rows), rows.schema.field("attempt").type)), "raw": pa.array(raw, pa.string())}
                columns = [made[f] if f in made else rows.column(f) for f in schema.fieldNames()]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return keyed.mapInArrow(run, schema)


def _candidates(raw: DataFrame, fewest_chars: int, most_words: int) -> DataFrame:
    lines = raw.select("*", F.posexplode(generated_list(F.col("raw"), fewest_chars)).alias("pos", "line"))
    fit = lines.withColumn("text", clamped(F.col("line"), most_words)).filter(rejection(F.col("text"), max_words=most_words).isNull())
    return fit.withColumn("key", direction_key(F.col("text"))).select("model", "target_year", "prompt", "attempt", "pos", "text", "key")


def listed(
    cells: DataFrame, generator: Generator, scorer: CompletionScorer, encoder: Encoder, n: int, style: str = "continuation", pool: float = 3.0,
    attempts: float = 2.0, each: int = 1, near: float = 0.85, most_words: int = 25, seed: int = 42,
) -> DataFrame:
    """(model, target_year, rank, text, score): the best n directions for each cell (model, context_year, target_year,
    context).

    A pool of n * pool is gathered in rounds, for all cells at once: the prompt of a round lists what the rounds before
    accepted, ``each`` answers are drawn from it, and their lines are accepted in order if they keep to the rules, are new
    and no near-duplicate. A cell is done when its pool is full, all are after n * pool * attempts answers. The pool is then
    ranked by the scores of its texts as completions of their prompts. A round is a checkpoint; its rows are few.
    """
    many = max(n, int(n * max(pool, 1.0)))
    tries = max(many, int(many * max(attempts, 1.0)))
    spark = cells.sparkSession
    accepted = spark.createDataFrame([], LISTS)

    def accept(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["attempt", "pos"]).reset_index(drop=True)
        vectors = encoder.encode(rows["text"].tolist())
        kept, keys = [], set()
        for k, row in enumerate(rows.itertuples()):
            new = row.attempt >= 0
            if row.key in keys or (new and (len(kept) >= many or (kept and float((vectors[kept] @ vectors[k]).max()) >= near))):
                continue
            kept.append(k)
            keys.add(row.key)
        out = rows.loc[kept].reset_index(drop=True)
        fresh = out["attempt"] >= 0
        scores = out["score"].astype(float)
        scores[fresh] = [float(scorer.score(p, [t])[0]) for p, t in zip(out["prompt"][fresh], out["text"][fresh], strict=True)]
        return out.assign(score=scores, place=range(len(out)))[["model", "target_year", "place", "text", "key", "score"]]

    for attempt in range(0, tries, each):
        lists = accepted.groupBy("model", "target_year").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x.text).alias("already"))  # a pool at most
        already = F.coalesce("already", F.array().cast("array<string>"))
        todo = cells.join(lists, ["model", "target_year"], "left").withColumn("already", already).filter(F.size("already") < many)
        prompts = todo.select("model", "target_year", prompt_for(style, F.col("context_year"), F.col("target_year"), F.col("context"), F.col("already")).alias("prompt"))
        if prompts.isEmpty():
            break
        new = _candidates(answered(prompts.withColumn("attempt", F.lit(attempt)), generator, min(each, tries - attempt), seed), 12, most_words)
        old = accepted.select("model", "target_year", F.lit("").alias("prompt"), F.lit(-1).alias("attempt"), F.col("place").alias("pos"), "text", "key", "score")
        both = old.unionByName(new.withColumn("score", F.lit(0.0)))
        accepted = settled(both.groupBy("model", "target_year").applyInPandas(accept, LISTS))
    return _best(accepted, n)


def _best(scored: DataFrame, n: int) -> DataFrame:
    from quillspark.operators.ranking import ranked

    top = ranked(scored, ["model", "target_year"], [F.desc("score"), F.col("text")]).filter(F.col("rank") <= n)
    return top.select("model", "target_year", "rank", "text", "score")


def listed_at_once(
    cells: DataFrame, generator: Generator, scorer: CompletionScorer, n: int, style: str = "continuation", oversample: int = 2, most_words: int = 25, seed: int = 42
) -> DataFrame:
    """The same from one prompt for each cell: n * oversample answers, their distinct valid lines, the best n by score."""
    none = F.array().cast("array<string>")
    prompts = cells.select("model", "target_year", prompt_for(style, F.col("context_year"), F.col("target_year"), F.col("context"), none).alias("prompt"))
    found = _candidates(answered(prompts, generator, max(n * oversample, n + 2), seed), 15, most_words).dropDuplicates(["model", "target_year", "key"])

    @F.pandas_udf("double")
    def score(given: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([float(scorer.score(p, [t])[0]) for p, t in zip(given, texts, strict=True)])

    return _best(found.withColumn("score", score("prompt", "text")), n)


def extracted(articles: DataFrame, generator: Generator, style: str = "topic", chat: bool = False, seed: int = 42) -> DataFrame:
    """(pmid, question, qc_score, segmentation_method) of articles (pmid, title, abstract): the direction that a model draws
    from each, polished, and how much it reads like one; a null question where the answer breaks the rules."""
    prompt = extraction_prompt(polished(F.coalesce("title", F.lit(""))), polished(F.coalesce("abstract", F.lit(""))), prompt_style(style), chat=chat)
    answers = answered(articles.select("pmid", prompt.alias("prompt")), generator, 1, seed)
    found = answers.select("pmid", F.inline(F.array(F.struct(parsed_direction(F.col("raw"), style).alias("direction")))))
    valid = F.coalesce(rejection(F.col("direction")).isNull(), F.lit(False)) & F.col("direction").isNotNull()
    return found.select("pmid", F.when(valid, F.col("direction")).alias("question"), F.when(valid, subjectness(F.col("direction"))).otherwise(0.0).alias("qc_score"), F.lit("llm").alias("segmentation_method"))
