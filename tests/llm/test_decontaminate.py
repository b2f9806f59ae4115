import random

from oracle import compare
from quillspark.llm import decontaminate as dc

RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(3000)]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def test_query_equals_sql(spark):
    assert compare(spark, dc.op6_decontaminate, dc.ORACLE["op6_decontaminate"], "/root/testdata/sf0.01") > 20


def fixture(spark):
    long, short, tiny = prose(70), prose(7), prose(3)
    items = [(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(tiny)), (4, None), (5, ""), (6, " ".join(long)), (6, " ".join(long))]
    edited = [w if k % 6 else "other" for k, w in enumerate(long)]
    docs = {
        10: prose(40) + long + prose(50), 11: prose(500) + edited + prose(9), 12: long[30:45], 13: prose(4) + short,
        14: prose(300), 15: tiny + prose(20), 16: prose(30) + long[:6] + prose(30), 17: short[:5] + ["x", "y"], 18: [], 20: prose(20000) + long[50:],
    }
    rows = [(d, " ".join(w), "c", 1) for d, w in docs.items()] + [(19, None, "c", 1), (None, ". ".join(long).upper() + "!", "c", 1)]
    rows += [rows[0], (10, "clean text of the same id", "c", 1)]
    columns = "doc_id long, text string, item_id string, score int"
    return spark.createDataFrame(rows, columns), spark.createDataFrame(items, "item_id long, text string"), {10, 11, 12, 13, 20, None}


def test_leaks_and_clean_documents(spark, monkeypatch):
    docs, benchmark, bad = fixture(spark)
    for block in (250_000, 60):
        monkeypatch.setattr(dc, "BLOCK_SEEDS", block)
        found = dc.leaks(docs, benchmark).collect()
        assert {r.doc_id for r in found} == bad
        assert {r.item_id for r in found if r.doc_id == 10} == {1, 6} and len([r for r in found if r.doc_id == 10]) == 2
    kept = dc.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10, 14, 15, 16, 17, 18, 19]


def test_empty_tables(spark):
    docs, benchmark, _ = fixture(spark)
    assert dc.leaks(docs.limit(0), benchmark).count() == 0
    assert dc.leaks(docs, benchmark.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = dc.op6_decontaminate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_items_without_an_id_leak_too(spark):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, "x " * 20 + " ".join(words)), (2, "y " * 60)], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(words)), (None, "other words " * 12), (5, " ".join(words[3:30]))], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()), key=repr)
    assert got == [(1, 5), (1, None)]


def test_texts_that_repeat_themselves_are_quick(spark):
    """Every place of one meets every place of the other, in few ways."""
    import time

    docs = spark.createDataFrame([(1, "la " * 3000), (2, "la la lo " * 700), (3, "plain words " * 3)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "la " * 400), (2, "la la lo " * 100)], "item_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.item_id): r.score for r in dc.leaks(docs, items).collect()}
    assert got[1, 1] == got[2, 2] == dc.VIEW and set(got) <= {(1, 1), (2, 2), (1, 2), (2, 1)}
    assert time.time() - began < 30
