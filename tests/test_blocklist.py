"""Copies of blocked texts against a comparison of all pairs, and what they take on disk."""

import os
import random

from quillspark.operators.blocklist import LONG, PREFIX, copies


def _alike(a, b):
    return a == b or (min(len(a), len(b)) >= LONG and (a[:PREFIX].startswith(b[:PREFIX]) or b[:PREFIX].startswith(a[:PREFIX])))


def test_copies_equal_a_comparison_of_all_pairs(spark):
    rng = random.Random(3)
    stem = "the role of sleep in memory of the elderly and " * 3
    cut = lambda: stem[: rng.randint(1, 120)].strip(" ") + rng.choice(["", "", "x", "xy", "é"])
    texts, blocked = [cut() for _ in range(400)] + ["", "?"], [cut() for _ in range(12)] + ["", "short"]
    rows = spark.createDataFrame(list(enumerate(texts * 2)), "id int, line string")
    got = copies(rows, "line", spark.createDataFrame([(b,) for b in blocked], "text string"), "text")
    assert got.columns == ["id", "line"]
    want = [k for k, a in enumerate(texts * 2) if a not in ("", "?") and any(_alike(a, b) for b in blocked if b)]
    assert 0 < len(want) < len(texts) * 2 and sorted(r.id for r in got.collect()) == want


def test_copies_write_less_than_they_read(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(4000)]
    spark.createDataFrame(list(enumerate(texts)), "id int, line string").write.parquet(f"{tmp_path}/lines")
    rows = spark.read.parquet(f"{tmp_path}/lines")
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {p for d in folders for at, _, names in os.walk(str(d)) for n in names if os.path.exists(p := f"{at}/{n}")}
    before = files()
    found = copies(rows, "line", rows.filter("id % 20 = 0").selectExpr("line as text"), "text").select("id")
    assert len(found.collect()) == len(texts[::20])
    assert sum(os.path.getsize(p) for p in files() - before if os.path.exists(p)) < sum(map(len, texts))
