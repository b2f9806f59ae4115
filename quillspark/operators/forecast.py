"""Prompts, training pairs, error examples and forecasters without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import capped
from quillspark.operators.pools import YEARS_BACK, tiered
from quillspark.operators.ranking import ranked, sampled_by_weight, top_fraction

CONTEXT_CHARS, COMPLETION_CHARS, LISTED = 280, 400, 15

# The wording of prompts.
TOPIC_PROMPT = """Extract the research topic this neuroscience paper studies — the aim/subject only.

Write ONE noun phrase (8-25 words). No question mark.
Do NOT include findings, results, conclusions, methods details, or phrases like "reveals", "finding that", "showing that", "study explores".
Focus on what was investigated, not what was found.

Example: Role of cerebellar nuclei in motor cortex control via thalamus

Title: {title}

Abstract:
{abstract}"""
SPECIFIC_PROMPT = """Extract the precise neuroscience research direction this paper pursues — the specific aim/subject only.

Write ONE specific research direction (8-25 words). No question mark.
Be concrete: phenomenon + population/model + angle. Do NOT write a broad paper-title paraphrase or an abstract summary.
Do NOT include findings, results, conclusions, methods details, or phrases like "reveals", "finding that", "showing that", "study explores".
Focus on what was investigated, not what was found.

Examples:
- Investigating the impact of prenatal maternal stress on cortical maturation and behavior in mice
- A human brain atlas of subcellular protein localization in 1000+ cell types, organized by cell type and brain region

Title: {title}

Abstract:
{abstract}"""
INSTRUCT = (
    "[INST] You forecast neuroscience research directions.\n",
    "Given themes known through year {context}, write exactly one novel research direction for year {target}.\n",
    "Rules: 8-25 words; noun phrase; no question mark; no years, DOI, or PMID; do not copy the themes.\n\n",
    "Themes through {context}:\n",
    "\nAlready written (do not repeat):\n",
    "Write one direction for {target}: [/INST] ",
)


def extraction_prompt(title: Column, abstract: Column, style: str = "topic", chars: int = 3500, chat: bool = False) -> Column:
    """The prompt that asks for an article's direction, in chat form between instruction marks; title and abstract are
    expected clean."""
    template = SPECIFIC_PROMPT if style == "specific" else TOPIC_PROMPT
    before, rest = template.split("{title}")
    between, after = rest.split("{abstract}")
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))
    whole = F.concat(F.lit(before), name, F.lit(between), capped(F.coalesce(abstract, F.lit("")), chars), F.lit(after))
    return F.concat(F.lit("[INST] "), whole, F.lit(" [/INST]")) if chat else whole


def continuation_prompt(context_year: Column, target_year: Column, context: Column, already: Column | None = None) -> Column:
    """Year, its themes, what is listed already, next year."""
    head = F.concat(F.lit("Year "), context_year, F.lit(":\n"))
    body = F.when(F.length(context) > 0, F.concat(context, F.lit("\n"))).otherwise("")
    listed = F.lit("")
    if already is not None:
        last = F.array_join(F.slice(already, F.greatest(F.size(already) - LISTED + 1, F.lit(1)), LISTED), "\n")
        listed = F.when(F.size(already) > 0, F.concat(F.lit("Already listed:\n"), last, F.lit("\n"))).otherwise("")
    return F.concat(head, body, listed, F.lit("Year "), target_year, F.lit(":\n"))


def instruct_prompt(context_year: Column, target_year: Column, context: Column, already: Column | None = None) -> Column:
    """The same task as an instruction."""
    part = lambda text: F.replace(F.replace(F.lit(text), F.lit("{context}"), context_year.cast("string")), F.lit("{target}"), target_year.cast("string"))
    start, given, rules, themes, avoid, ask = map(part, INSTRUCT)
    listed = F.lit("")
    if already is not None:
        last = F.transform(F.slice(already, F.greatest(F.size(already) - LISTED + 1, F.lit(1)), LISTED), lambda a: F.concat(F.lit("- "), a))
        listed = F.when(F.size(already) > 0, F.concat(avoid, F.array_join(last, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(start, given, rules, themes, context, F.lit("\n"), listed, ask)


def prompt_for(style: str, context_year: Column, target_year: Column, context: Column, already: Column | None = None) -> Column:
    """The prompt of a style: continuation or instruct. A context that isn't before its target is an error."""
    styles = {"continuation": continuation_prompt, "instruct": instruct_prompt}
    if style not in styles:
        raise ValueError(f"no style {style!r}: one of {sorted(styles)}")
    late = F.raise_error(F.concat(F.lit("a context of "), context_year.cast("string"), F.lit(" for "), target_year.cast("string"))).cast("string")
    return F.when(context_year < target_year, styles[style](context_year, target_year, context, already)).otherwise(late)


def context_rows(questions: DataFrame, years: DataFrame, most: int) -> DataFrame:
    """(window, place, id, question_text): the best questions for each year asked for, of it and the years before, for all
    years in one pass. A question belongs to the windows of six years, so rows are copied six times and then cut to
    ``most``."""
    spread = questions.withColumn("window", F.explode(F.sequence(F.col("year"), F.col("year") + YEARS_BACK))).join(years.select(F.col("year").alias("window")).distinct(), "window")
    order = [F.desc(F.coalesce("impact_score", F.lit(0.0))), F.desc("year"), F.col("question_text"), F.col("id")]
    return ranked(spread, ["window"], order, "place").filter(F.col("place") <= most)


def contexts(questions: DataFrame, years: DataFrame, most: int) -> DataFrame:
    """(year, context): the texts of context_rows, a line each."""
    best = context_rows(questions, years, most)
    text = F.substring(F.trim("question_text"), 1, CONTEXT_CHARS)
    lists = best.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("place", text.alias("t")))).alias("l"))  # most rows
    return lists.select(F.col("window").alias("year"), F.array_join(F.transform("l", lambda x: x.t), "\n").alias("context"))


def training_pairs(questions: DataFrame, year_max: int, fraction: float = 0.7, most: int = 0, context: int = 30, weighted: bool = False, seed: int = 42) -> DataFrame:
    """(target_year, prompt, completion): the context of a year with each chosen question of the next, both up to
    year_max; a year without questions of its own gives none."""
    known = questions.filter(F.col("year") <= year_max)
    years = known.select("year").distinct().filter(F.col("year") < year_max)
    order = [F.desc(F.coalesce("impact_score", F.lit(0.0))), F.col("question_text"), F.col("id")]
    if weighted:
        chosen = sampled_by_weight(known, ["year"], most or 1 << 30, seed, "question_text", F.coalesce("impact_score", F.lit(0.0)), "id")
    else:
        chosen = top_fraction(known, ["year"], order, fraction, most)
    prompts = contexts(known, years, context).select((F.col("year") + 1).alias("year"), continuation_prompt(F.col("year"), F.col("year") + 1, F.col("context")).alias("prompt"))
    return chosen.join(prompts, "year").select(F.col("year").alias("target_year"), "prompt", F.substring("question_text", 1, COMPLETION_CHARS).alias("completion"))


def error_examples(questions: DataFrame, missed: DataFrame, year: int, most: int = 50) -> DataFrame:
    """(id, completion) of the ground truth of a year that predictions missed, by id; ``missed`` has the ids."""
    truth = tiered(questions.filter(F.col("year") == year), clean=False)
    return truth.join(missed.select("id"), "id", "left_semi").orderBy("id").limit(most).select("id", F.substring("question_text", 1, COMPLETION_CHARS).alias("completion"))


def frequency_forecast(questions: DataFrame, years: DataFrame, k: int) -> DataFrame:
    """(target_year, rank, text, score): for each year the k most frequent questions of the year before."""
    past = questions.withColumn("target_year", (F.col("year") + 1).cast("int")).join(years.select(F.col("year").alias("target_year")).distinct(), "target_year")
    counted = past.groupBy("target_year", F.col("question_text").alias("text")).agg(F.count("*").cast("double").alias("score"))
    return ranked(counted, ["target_year"], [F.desc("score"), F.col("text")]).filter(F.col("rank") <= k).select("target_year", "rank", "text", "score")


def random_forecast(questions: DataFrame, years: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(target_year, rank, text, score): for each year k questions of the window before it, in hash order."""
    windows = questions.select("year", "question_text", F.explode(F.sequence(F.col("year") + 1, F.col("year") + 1 + YEARS_BACK)).alias("target_year"))
    asked = windows.withColumn("target_year", F.col("target_year").cast("int")).join(years.select(F.col("year").alias("target_year")).distinct(), "target_year")
    distinct = asked.select("target_year", F.col("question_text").alias("text")).distinct().withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("target_year").cast("string"), F.lit(":"), F.col("text")).cast("binary")))
    return ranked(distinct, ["target_year"], [F.col("draw"), F.col("text")]).filter(F.col("rank") <= k).select("target_year", "rank", "text", F.lit(0.0).alias("score"))
