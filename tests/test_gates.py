"""Rules that look for a sign or a word before they try a pattern, against the patterns alone."""

import random

from pyspark.sql import functions as F

from quillspark.functions import directions as D
from quillspark.functions import lines as L
from quillspark.functions import patterns as P
from quillspark.functions import text as X
from quillspark.operators import audit
from quillspark.plans.common import SAMPLES

ODD = ["ſ", "K", "ı", "İ", "\t", "\xa0", "\x85", " ", "　", "\x1c", "é", "–", "  ", "?", ".", ";", " "]


def _texts():
    rng = random.Random(5)
    out = [*SAMPLES, *ODD, "  a  b ", "x ?", "x??", "abc .;:?", "Hoſpital of Genève", "reſearch directionſ liKely to be ſtudied", "PMİD : 5", "We aimed to see it,  by hand"]
    for s in SAMPLES * 4:
        cut = rng.randint(0, len(s))
        swapped = "".join({"s": "ſ", "k": "K", "i": "İ", " ": rng.choice(ODD)}.get(c, c) if rng.random() < 0.2 else c for c in s)
        out += [s[:cut] + rng.choice(ODD) + s[cut:], swapped, swapped.upper()]
    return out


def _strip(t):
    return X.cut(t, r"^\s+|\s+$")


def _space(t):
    return X.cut(_strip(t), r"\s+", " ")


def _bare(t):
    return _strip(X.cut(X.cut(X.cut(_strip(t), r"^\d+[.):\-]\s*"), r"^[-*•]\s*"), r"\?\z"))


def _polished(t):
    for pattern in (P.EMAIL, P.ADDRESS, P.INDEXED_AUTHOR):
        t = X.cut(t, pattern, " ")
    return _strip(X.cut(X.cut(t, P.LEADING_AUTHOR), r"\s{2,}", " "))


def _span(t):
    s = X.cut(X.cut(X.cut(_polished(t), P.LEADING_FILLER), P.TRAILING_CLAUSE), r"\s{2,}", " ")
    return X.cut(X.cut(s, r"^[ .;:]+|[ .;:]+$"), r"\s*\?\z")


def test_text_functions_equal_their_patterns(spark):
    df = spark.createDataFrame([(t,) for t in [*_texts(), None]], "t string").repartition(4)
    t = F.col("t")
    pairs = {
        "stripped": (X.stripped(t), _strip(t)), "space": (X.normal_space(t), _space(t)), "words": (X.n_words(t), F.size(X.words(F.coalesce(t, F.lit(""))))),
        "bare": (D.bare(t), _bare(t)), "key": (D.direction_key(t), _strip(X.cut(_space(F.lower(_bare(t))), r"[.,;:!]+$"))), "polished": (L.polished(t), _polished(t)),
        "span": (D.compressed_span(t, 10_000, 0), _span(t)),
    }
    for name, (mine, plain) in pairs.items():
        assert not df.filter(~mine.eqNullSafe(plain)).select(F.lit(name), t, mine, plain).take(3)


def test_signs_and_words_stand_in_all_that_patterns_find(spark):
    df = spark.createDataFrame([(t,) for t in _texts()], "t string").repartition(4).withColumn("low", X.folded(F.col("t")))
    t, low = F.col("t"), F.col("low")
    needs = {
        P.PROMPT_LEAK: X.contains_any(low, *P.LEAK_PARTS), P.AFFILIATION_WORDS: X.contains_any(low, *P.AFFILIATION_PARTS), P.CITY_COUNTRY: t.contains(","),
        P.AUTHOR_ONLY: t.contains("("), P.AUTHOR_LINE: t.contains("("), P.AFFILIATION_LINE: t.contains("("), P.INDEXED_AUTHOR: t.contains("("), P.HEAVY_INDEX: t.contains("("),
        P.EMAIL: t.contains("@"), P.ADDRESS: low.contains("address:"), P.POSTAL_LINE: t.rlike(P.java(r"\d")), P.TRAILING_CLAUSE: X.has(t, P.TRAILING_START),
        P.JUNK[0]: t.contains(":") & X.contains_any(low, "doi", "pmid", "pmcid"), P.JUNK[1]: low.contains("comment in"), P.JUNK[2]: t.contains("(") & low.contains("contributed equally"),
        P.JUNK[3]: t.contains(":") & low.contains("collaborator"), P.JUNK[4]: low.contains("update of"), P.IDS: t.contains(":") & X.contains_any(low, "pmid", "pmcid"),
        P.DOI: (t.contains(":") & low.contains("doi")) | t.contains("10."), P.COMMENT: X.contains_any(low, "comment in", "contributed equally"),
        P.AUTHOR_HEAVY: t.contains("(") | low.contains("collaborator"), P.DEGENERATE: t.contains("#") | t.rlike(P.java(r"\d\.")),
    }
    bad = [F.when(X.has(t, pattern) & ~need, F.lit(pattern)) for pattern, need in needs.items()]
    assert not df.select("t", F.array_compact(F.array(*bad)).alias("bad")).filter(F.size("bad") > 0).take(3)


def test_audits_judge_lines_once(spark, tmp_path):
    spark.createDataFrame([(k % 5, k, t) for k, t in enumerate(_texts())], "id int, pos int, line string").write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    for made in (audit.log_lines(lines, ["id"], "line", "pos"), audit.generation_log(lines, ["id"], "line", "pos")):
        assert made.count() and "RLIKE" not in made._jdf.queryExecution().optimizedPlan().toString().upper()


def test_baselines_read_documents_once(spark):
    from quillspark.plans import forecasts

    found = forecasts.baseline_bm25(spark, "/root/testdata/sf0.001")
    assert found.columns == ["year", "rank", "id", "text"] and not found.inputFiles()
