"""Golden examples of the text rules, one positive and one negative a reason."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import directions as D
from quillspark.functions import lines as L
from quillspark.functions import text as X
from quillspark.operators.blocklist import copies

GOOD = "Role of hippocampal plasticity in spatial memory and attention during aging"
REASONS = {
    "empty": " 1. ?", "too_short_chars": "- short line", "fewshot_copy": "Prefrontal dopamine signaling in flexible decision making",
    "prompt_leak": "Propose exactly ten directions for the next year", "instruction_line": "Write exactly one direction for the coming year",
    "year_prefix": "[2020] a direction that is long enough to pass the rest", "doi_pmid": "a direction with doi: 10.1000/182 inside it",
    "comment_in": "a long enough line with Comment in Nature of last year", "author_heavy": "a long enough line with names(1)(2) in the middle of it",
    "degenerate": "## # a long enough line of signs and little else", "number_only": "12 34 56 78 90 12 34", "junk_sentence": "Department of Neurology, Hospital of the City",
    "narrative_here_we": "here we " + "go on and on " * 8, "too_few_words": "only five words are here", "too_many_words": "word " * 26, "question_mark": GOOD + "??",
}


def evaluate(spark, column, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("text")).alias("v")).collect()]


def test_rejection_reasons(spark):
    assert evaluate(spark, D.rejection, [*REASONS.values(), GOOD]) == [*REASONS, None]
    assert set(REASONS) | {"context_copy"} == set(D.NOISE + D.LENGTHS)


def test_priority_of_reasons(spark):
    both = "[2019] Propose exactly ten with a doi: 10.1000/1 and Comment in it"
    assert evaluate(spark, D.rejection, [both]) == ["prompt_leak"]


def test_leak_patterns_that_end_in_a_colon_need_a_word_after_it(spark):
    assert evaluate(spark, D.is_leak, ["TASK:x and more", "TASK: x and more", "", GOOD]) == [True, False, True, False]


@pytest.mark.parametrize(("line", "citation", "metadata"), [
    ("1. J Neurosci. 2019 Mar 5;39(10):1-12.", True, False), ("Epub 2020 Jan 3.", True, False), ("plain prose about cells", False, False),
    ("Smith JA(1), Müller B(2).", False, True), ("Paris, France.", False, True), ("write to a.b@c.org", False, True), ("Lee HS", False, True),
    ("We studied patients of the University and found much", False, False), ("", False, False),
])
def test_lines(spark, line, citation, metadata):
    assert evaluate(spark, L.is_citation, [line]) == [citation]
    assert evaluate(spark, L.is_metadata, [line]) == [metadata]


def test_spans_and_scores(spark):
    texts = ["We aimed to examine the role of dopamine in flexible decisions, using optogenetics in mice", "too short span", GOOD, "x " * 40]
    assert evaluate(spark, D.compressed_span, texts) == ["examine the role of dopamine in flexible decisions", None, GOOD, "x " * 24 + "x"]
    scores = evaluate(spark, D.subjectness, [GOOD, "", "we found cells were active in mice and rats"])
    assert scores[1] == 0.0 and 0 <= scores[2] < scores[0] <= 1


def test_white_space_and_accents(spark):
    assert evaluate(spark, X.normal_space, ["  a  b\n"]) == ["a b"]
    assert evaluate(spark, X.tokens, ["Café α-Synuclein don't"]) == [["caf", "α-synuclein", "don't"]]
    assert evaluate(spark, X.trigrams, ["a b c d", "a b", ""]) == [["a b c", "b c d"], ["a b"], []]
    assert evaluate(spark, lambda c: X.capped(c, 10), ["0123456789", "01234567890"]) == ["0123456789", "0123456..."]


def test_parsed_directions(spark):
    raw = ["Rules: none\n---\n1. Study of thalamic gating in attention showing that it matters", "  ", "note: x"]
    assert evaluate(spark, D.parsed_direction, raw) == ["thalamic gating in attention", None, "note: x"]
    assert evaluate(spark, D.generated_list, ["1. A first direction of work\n2) a FIRST direction of work\nshort", "one line that is long"]) == [["A first direction of work"], ["one line that is long"]]


def test_blocklist_copies_whole_and_by_their_start(spark):
    long = "a very long blocked direction that goes on for much more than eighty characters in all, as this one does"
    blocked = spark.createDataFrame([(long,), ("short one",), (long[:50],)], "b string")
    texts = [long.upper() + ".", long[:45], long + " and more", "Short one!", "short one more", long[:30], "x" + long, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert sorted(r.k for r in copies(df, "t", blocked, "b").collect()) == [0, 1, 2, 3]


def test_rules_are_idempotent(spark):
    for f in (X.normal_space, X.verbatim_key, L.polished, D.clamped):
        once = evaluate(spark, f, [GOOD, "  (x) A B  c", "a  b. "])
        assert evaluate(spark, f, once) == once
