from pyspark.sql import functions as F

from oracle import compare
from quillspark.llm.mixing import ORACLE, emitted, mix_sources, op8_mixing
from quillspark.llm.shared import word_count

SCHEMA = "doc_id long, text string, source string, size long, Target string, copies string"


def test_query_equals_sql(spark):
    assert compare(spark, op8_mixing, ORACLE["op8_mixing"], "/root/testdata/sf0.01") == 1000


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(i % 40, "x", ["a", "b", None, "a"][i % 4], (i * 7) % 90 if i % 9 else None, "keep", "old") for i in range(400)]
    rows += [(None, None, None, None, None, None), (5, "same", "a", 9, "t", "c"), (5, "same", "a", 9, "t", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs.withColumnRenamed("Target", "Goal"))
    found = got.collect()
    assert len(found) == 403 and {"Goal", "target", "copies"} <= set(got.columns)
    assert all(0 <= r.copies <= 2 for r in found)
    by = {}
    for r in found:
        t = by.setdefault(r.source, [0, r.target])
        t[0] += (r.size or 0) * r.copies
    assert all(abs(a - b) <= 180 for a, b in by.values())
    assert abs(sum(b for _, b in by.values()) - 1.5 * sum(r.size or 0 for r in found)) < 1e-6
    assert sorted(map(repr, found)) == sorted(map(repr, mix_sources(docs.withColumnRenamed("Target", "Goal")).collect()))
    assert emitted(got).count() == sum(r.copies for r in found)


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA).drop("Target")).count() == 0


def test_word_count(spark):
    texts = ["", " ", "\n\t", "a", " a", "a ", " a\x0bb\r\n c ", None, " ", "é \x1c x"]
    want = [len((t or "").encode().split()) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r[0] for r in df.orderBy("i").select(word_count(F.col("text"))).collect()] == want
