"""Stores, samples, similarity and evaluation: properties, and small brute-force twins."""

import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.models import BigramScorer, HashingEncoder, encoded
from quillspark.operators import evaluate as E
from quillspark.operators import ranking as R
from quillspark.operators import similarity
from quillspark.operators.pools import context_window, tiered
from quillspark.operators.store import Store, merge_upsert
from quillspark.sources.tables import settled

NOW = datetime(2024, 5, 1)


def test_upsert_is_idempotent_and_last_writer_wins(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    delta = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1), (None, 9, 1)], "k string, v int, n int")
    once = merge_upsert(base, delta, ["k"], [F.desc("n")])
    twice = merge_upsert(once, delta, ["k"], [F.desc("n")])
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 6), ("c", 7), (None, 9)}


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("articles").count() == 0 and store.latest_run("predict") is None
    arts = spark.createDataFrame([("1", 2020, "abc", None), ("2", 2021, "def", "work")], "pmid string, year int, abstract string, text_work string")
    store.upsert_articles(arts, NOW)
    store.upsert_articles(arts.filter("pmid = '1'").withColumn("year", F.lit(1999)), NOW)
    assert {(r.pmid, r.year, r.text_work) for r in store.read("articles").collect()} == {("1", 1999, "abc"), ("2", 2021, "work")}
    preds = lambda run, n: spark.createDataFrame([(2023, "m", k, f"t{k}", run) for k in range(1, n + 1)], "target_year int, model string, rank int, question_predicted string, run_id string")
    store.replace_predictions(preds("r1", 3))
    store.replace_predictions(preds("r2", 2))
    store.replace_predictions(preds("r1", 1))
    assert sorted((r.run_id, r.rank) for r in store.read("predictions").collect()) == [("r1", 1), ("r2", 1), ("r2", 2)]
    store.log_run("p1", "predict", NOW)
    store.log_run("p2", "predict", datetime(2024, 6, 1))
    assert store.latest_run("predict") == "p2"
    store.clear_derived()
    assert store.read("predictions").count() == 0 and store.read("articles").count() == 2 and store.latest_run("predict") == "p2"


def test_pools_fall_back(spark):
    good = "Role of hippocampal plasticity in spatial memory and attention during aging"
    rows = [(1, 2020, good, 1), (2, 2020, good, 0), (3, 2021, good, 0), (4, 2021, "PMID: 5 junk line of metadata", 1), (5, 2022, "short", 1), (6, 2022, "", 1)]
    df = spark.createDataFrame(rows, "id int, year int, question_text string, is_critical int").withColumn("impact_score", F.lit(1.0))
    assert {(r.id, r.tier) for r in tiered(df).collect()} == {(1, 1), (3, 2), (5, 3)}
    assert {r.id for r in context_window(df, 2021, 2).collect()} <= {1, 2, 3, 4}
    assert {r.id for r in context_window(df, 2040, 3).collect()} and context_window(df, 1990, 3).count() == 0


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "id int, t string")
    for f in (lambda d: R.sampled(d, 20, 42, "t"), lambda d: R.split_off(d, 0.1, 1, "t").filter("part = 'val'")):
        assert sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(df.repartition(7)).collect()))
    assert R.split_off(df, 0.1, 1, "t").filter("part = 'val'").count() == 30
    assert R.split_off(df.limit(9), 0.5, 1, "t").filter("part = 'val'").count() == 0
    heavy = df.withColumn("w", F.when(F.col("id") < 10, 1000.0).otherwise(0.0))
    assert sum(r.id < 10 for r in R.sampled_by_weight(heavy.withColumn("g", F.lit(1)), ["g"], 10, 3, "t", F.col("w")).collect()) == 10


def test_samples_of_equal_texts_go_by_the_named_columns(spark):
    df = spark.range(300).selectExpr("id", "'same' t", "1 g").repartition(7).orderBy(F.desc("id"))
    for f in (lambda d: R.sampled(d, 20, 42, "t", "id"), lambda d: R.sampled_by_weight(d, ["g"], 20, 42, "t", F.lit(1.0), "id")):
        assert sorted(r.id for r in f(df).collect()) == list(range(20))


def vectors(spark, rng, n, cells, first=0):
    rows = []
    for k in range(n):
        v = rng.normal(size=8)
        rows.append((k % cells, first + k, (v / np.linalg.norm(v)).tolist()))
    return spark.createDataFrame(rows, "cell int, id int, embedding array<float>"), rows


@pytest.mark.parametrize("block", [4096, 5])
def test_best_similarity_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(3)
    (left, a), (right, b) = vectors(spark, rng, 40, 3), vectors(spark, rng, 33, 2, 100)
    got = {r.key: r.best for r in similarity.best_similarity(left, right, "cell").collect()}
    want = {i: max(float(np.dot(v, w)) for d, _, w in b if d == c) for c, i, v in a if c < 2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_products_of_a_block_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    asked, known, ranks = rng.normal(size=(3000, 16)), rng.normal(size=(3000, 16)), rng.integers(1, 4000, 3000)
    tracemalloc.start()
    best = similarity.best_of_products(asked, known, ranks, [0, 10, 900, 5000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all products at once are 72 MB
    whole = asked @ known.T
    assert best.keys() == {k for k in (0, 10, 900, 5000) if (ranks <= k).any()}
    assert all(np.allclose(best[k], whole[:, ranks <= k].max(axis=1)) for k in best)


def test_metric_properties(spark):
    rng = np.random.default_rng(5)
    (preds, _), (refs, _) = vectors(spark, rng, 60, 3), vectors(spark, rng, 50, 3, 1000)
    preds = R.ranked(preds, ["cell"], [F.col("id")])
    before = None
    for tau in (0.2, 0.5, 0.8):
        rows = E.precision_recall(preds, refs, [5, 10], tau).collect()
        assert all(0 <= r.precision <= 1 and 0 <= r.recall <= 1 and r.recall_bounded <= 1 for r in rows)
        hits = sum(r.precision * r.n_preds for r in rows)
        assert before is None or hits <= before
        before = hits
        for r in E.beyond_retrieval(preds.filter("rank % 2 = 0"), preds.filter("rank % 2 = 1"), refs, 20, tau).collect():
            assert r.n_union == r.n_baseline + r.n_beyond and r.n_beyond <= r.n_model
    assert E.precision_recall(preds.limit(0), refs, [5], 0.5).filter("precision <> 0 or recall <> 0").count() == 0
    one = E.diversity(preds.filter("rank = 1"), 5).collect()
    assert all(r.n == 1 and r.pairwise == 0 and r.entropy is None for r in one)


def test_near_duplicates_are_refused_in_order(spark):
    rows = [(1, 1, "a b c d"), (1, 2, "a b c d"), (1, 3, "w x y z"), (1, 4, "a b c d e"), (2, 1, "a b c d")]
    df = encoded(spark.createDataFrame(rows, "g int, rank int, text string").withColumn("key", F.col("text")), "text", HashingEncoder())
    kept = similarity.kept_apart(df, ["g"], "rank", "text", "key", "embedding", 0.7)
    assert sorted((r.g, r.rank) for r in kept.collect()) == [(1, 1), (1, 3), (2, 1)]


def test_scorer_prefers_what_it_has_seen(spark):
    df = spark.createDataFrame([(k, "the cat sat on the mat") for k in range(9)] + [(9, "dogs bark")], "id int, t string")
    rng = random.Random(1)
    words = ["zebra", "quux", "flim", "flam"]
    ask = spark.createDataFrame([(1, "the cat sat"), (2, " ".join(rng.choices(words, k=3))), (3, "")], "id int, t string")
    ppl = {r.id: r.ppl for r in BigramScorer.fitted(df, "t").perplexities(ask, "id", "t").collect()}
    assert ppl.keys() == {1, 2} and ppl[1] < ppl[2]


def test_prototypes_tell_their_own_sentences(spark):
    from quillspark.functions.patterns import PROTOTYPES
    from quillspark.operators.classify import classified

    rows = [(label, text) for label, texts in PROTOTYPES.items() for text in texts] + [("subject", " "), ("subject", None)]
    got = classified(spark.createDataFrame(rows, "want string, t string"), "t", HashingEncoder()).collect()
    assert all(r.want == r.label and 0 <= r.confidence <= 1 for r in got)
    assert {r.confidence for r in got if not (r.t or "").strip()} == {0.0}
    assert {r.label for r in classified(spark.createDataFrame(rows, "want string, t string"), "t", None).collect()} == {"subject"}


def test_index_run(spark, tmp_path):
    from quillspark.operators.drivers import index_counts, is_ready, run_index

    store = Store(spark, f"file://{tmp_path}/index")
    good = "Role of hippocampal plasticity in spatial memory and attention during aging"
    ids = [str(k) for k in range(6)]
    store.upsert_articles(spark.createDataFrame([(k, 2015 + int(k) % 2, "text") for k in ids], "pmid string, year int, abstract string"), NOW)
    with pytest.raises(RuntimeError):
        run_index(store, HashingEncoder(), 2024, NOW)
    store.upsert("citations", spark.createDataFrame([(k, int(k)) for k in ids], "pmid string, citation_count long"), ["pmid"], [F.desc("citation_count")])
    store.upsert("article_segments", spark.createDataFrame([(k, f"{good} {k}", 0.8) for k in ids] + [("9", good, 0.8)], "pmid string, question string, qc_score double"), ["pmid"], [F.desc("question")])
    counts = run_index(store, HashingEncoder(), 2024, NOW)
    assert counts == {"articles": 6, "cited": 6, "segmented": 6, "questions": 6, "embedded": 6} and is_ready(index_counts(store))
    assert run_index(store, HashingEncoder(), 2024, NOW) == counts
    rows = {r.pmid: r for r in store.read("questions").collect()}
    assert rows["5"].is_critical + rows["4"].is_critical >= 1 and len(rows["0"].embedding) == 384


def test_collecting_goes_on_from_what_is_stored(spark, tmp_path):
    from quillspark.operators.drivers import citation_run, collect_run
    from quillspark.sources.collect import Collect

    store = Store(spark, f"file://{tmp_path}/index")
    what = Collect(year_from=2019, year_to=2020)
    lost = collect_run(store, what, "test_sources:FakeClient", NOW, most=10, wait=0.0)
    assert store.read("articles").count() == 7 and {r.pmid[-1] for r in lost.collect()} == {"2"}
    collect_run(store, what, "test_sources:FakeClient", NOW, wait=0.0)
    rows = store.read("articles").collect()
    assert len(rows) == 48 and all(r.text_work == r.abstract == f"We looked at cells of {r.pmid}" and r.doi == f"10.1/{r.pmid}" for r in rows)
    assert citation_run(store, "test_sources:FakeClient", NOW, 0.0) == 48 and citation_run(store, "test_sources:FakeClient", NOW, 0.0) == 0
    assert {(r.pmid[-1], r.citation_count) for r in store.read("citations").collect()} == {("0", 0), ("1", 13)}


def test_lists_feed_what_is_accepted_back(spark):
    from quillspark.functions.models import Loaded
    from quillspark.operators.generate import answered, listed, listed_at_once

    class Telling:
        """Answers with a direction that counts how many lines the prompt lists."""

        def generate(self, prompt, n, seed):
            many = len(re.findall(r"^Role of sleep stage \d+ ", prompt, re.M))
            return [f"1. Role of sleep stage {many} in memory consolidation of adult mice {'abcdefghijklmnopqrstuvwxyz'[many] * 9}"] * n

    class Longest:
        def score(self, prompt, texts):
            return np.array([float(re.search(r"stage (\d+)", t)[1]) for t in texts])

    cells = spark.createDataFrame([("m", 2019, 2020, "Theme of the year"), ("n", 2019, 2020, "")], "model string, context_year int, target_year int, context string")
    got = listed(cells, Telling(), Longest(), HashingEncoder(), 2, pool=3.0, near=0.999).collect()
    assert sorted((r.model, r.rank, re.search(r"stage (\d+)", r.text)[1]) for r in got) == [("m", 1, "5"), ("m", 2, "4"), ("n", 1, "5"), ("n", 2, "4")]
    assert len(listed(cells, Telling(), Longest(), HashingEncoder(), 2, near=0.999, each=4).collect()) == 4
    assert [r.rank for r in listed_at_once(cells, Telling(), Longest(), 3).collect()] == [1, 1]
    late = cells.withColumn("target_year", F.lit(2019))
    with pytest.raises(Exception, match="a context of 2019 for 2019"):
        listed(late, Telling(), Longest(), HashingEncoder(), 1).collect()
    made = Loaded(Telling)
    assert made.generate("x", 1, 1) == Telling().generate("x", 1, 1) and answered(cells.select(F.lit("p").alias("prompt")), made, 3).count() == 6


def test_runs_from_directions_to_metrics(spark, tmp_path):
    from quillspark.functions.models import EchoGenerator
    from quillspark.operators.drivers import direction_run, embed_missing, evaluate_run, predict_run, run_index

    store = Store(spark, f"file://{tmp_path}/index")
    rng = random.Random(4)
    words = "cortical hippocampal synaptic thalamic dopamine sleep memory attention plasticity motor learning reward circuits aging stress".split()
    text = lambda: "Role of " + " ".join(rng.sample(words, 8))
    store.upsert_articles(spark.createDataFrame([(str(k), 2017 + k % 4, text(), text()) for k in range(80)], "pmid string, year int, title string, abstract string"), NOW)
    assert direction_run(store, EchoGenerator(), NOW) == 80 and direction_run(store, EchoGenerator(), NOW) == 0
    assert {r.segmentation_method for r in store.read("article_segments").collect()} == {"llm"}
    store.upsert("article_segments", spark.createDataFrame([(str(k), text(), 0.9) for k in range(80)], "pmid string, question string, qc_score double"), ["pmid"], [F.desc("question")])
    store.upsert("citations", spark.createDataFrame([(str(k), k) for k in range(80)], "pmid string, citation_count long"), ["pmid"], [F.desc("citation_count")])
    run_index(store, HashingEncoder(), 2024, NOW)
    impact = {r.pmid: r for r in store.read("article_impact").collect()}
    assert len(impact) == 80 and impact["79"].impact_score == pytest.approx(79 / 4) and impact["79"].is_critical == 1
    blank = store.read("questions").withColumn("embedding", F.when(F.col("year") < 2019, F.col("embedding")))
    store.write("questions", settled(blank))
    assert embed_missing(store, None, NOW) == 40 and store.read("questions").filter("embedding is null").count() == 0
    run_index(store, HashingEncoder(), 2024, NOW, force=True)
    store.write("questions", settled(store.read("questions").withColumn("embedding", F.lit(None).cast("array<float>"))))
    assert embed_missing(store, HashingEncoder(), NOW) == 80
    with pytest.raises(ValueError, match="no model"):
        predict_run(store, ["other"], [2019], 3, NOW)
    run = predict_run(store, ["frequency", "random", "echo"], [2019, 2020], 5, NOW, {"echo": EchoGenerator()}, each=10)
    rows = store.read("predictions").collect()
    assert {(r.model, r.target_year) for r in rows} == {(m, y) for m in ("frequency", "random", "echo") for y in (2019, 2020)} and {r.run_id for r in rows} == {run}
    evaluated = evaluate_run(store, HashingEncoder(), [2019, 2020], [3, 5], 0.5, NOW)
    found = {(r.target_year, r.model, r.metric, r.k): r.value for r in store.read("evaluations").collect()}
    names = {m for _, _, m, _ in found}
    assert {"precision", "recall", "baseline_context_copy_precision", "baseline_corpus_bm25_recall", "beyond_conditional_corpus_vectors", "length_controlled_precision_model", "length_controlled_recall_context_copy", "format_frac_valid", "pairwise"} <= names
    assert all(np.isfinite(v) for v in found.values()) and {r.run_id for r in store.read("evaluations").collect()} == {evaluated}
    assert {r.stage for r in store.read("runs").collect()} == {"direction", "index", "embed", "predict", "eval"}


def test_matchers_fall_back(spark):
    from quillspark.operators.retrieval import matched, tfidf_embedded

    preds = spark.createDataFrame([("a", "sleep and memory in mice"), ("b", "unrelated words here")], "id string, text string")
    refs = spark.createDataFrame([("x", "memory and sleep in old mice"), ("y", "motor cortex"), ("z", "motor cortex")], "id string, text string")
    hits = lambda *more: {r.id: r.hit for r in matched(preds, refs, 0.5, *more).collect()}
    assert hits() == hits("tfidf") == hits("TF-IDF") == {"a": True, "b": False} and hits("minilm", HashingEncoder())["a"]
    with pytest.raises(ValueError, match="no matcher"):
        matched(preds, refs, 0.5, "other")
    rows = {r.id: r.embedding for r in tfidf_embedded(refs.union(spark.createDataFrame([("w", "a")], "id string, text string")), "id", "text", 3).collect()}
    assert rows["y"] == rows["z"] and all(len(v) == 3 for v in rows.values()) and not any(rows["w"]) and sum(x * x for x in rows["y"]) == pytest.approx(1)


def test_appending_adds_parts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    rows = lambda n: spark.createDataFrame([(2020, "m", "p", n, 1.0)], "target_year int, model string, metric string, k int, value double")
    for n in range(3):
        store.append("evaluations", rows(n))
    assert sorted(r.k for r in store.read("evaluations").collect()) == [0, 1, 2]
    store.write("evaluations", rows(9))
    assert [r.k for r in store.read("evaluations").collect()] == [9]


def test_class_prototypes_takes_all_lines(spark, tmp_path):
    import numpy as np

    from quillspark.functions.models import HashingEncoder
    from quillspark.operators.classify import centroids
    from quillspark.plans import common as C
    from quillspark.plans.audits import class_prototypes

    texts = {1: "Role of dopamine in learning\n\nwe recorded neurons in mice", 2: "one line", 3: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    named = centroids(HashingEncoder())
    want = {}
    lines = [(d, k, x) for d, t in texts.items() for k, x in enumerate(t.split("\n"))] + [(-1 - k, 0, x) for k, x in enumerate(C.SAMPLES)]
    for d, k, line in lines:
        scores = {label: float(np.dot(HashingEncoder().encode([line])[0], v)) for label, v in named.items()}
        one, two = sorted(scores.values(), reverse=True)[:2]
        sure = min(max((one + 1) / 2 * (0.5 + 0.5 * (one - two)), 0), 1)
        want[d, k] = (max(scores, key=scores.get), sure) if line.strip() else ("subject", 0.0)
    got = class_prototypes(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    for r in got:
        label, sure = want[r.id, r.pos]
        assert r.label == label and abs(r.confidence - sure) < 1e-5
