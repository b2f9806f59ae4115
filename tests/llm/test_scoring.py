import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm.mixer import ALL_STATES, BINS_A_UNIT, BLOCK, CELLS, LIMIT, RATE, REACH, STEPS, Code, Counts, Mixer, Spelling, Table, gathered, ordered
from quillspark.llm import scoring
from quillspark.llm.scoring import Vocabulary, op2_lm_scoring, scored, split_words

SF = "/root/testdata/sf0.1"


def brute(rows):
    """doc_id: (n_tokens, n_known, N, base) by the definition."""
    split = [(d, held, [*(t or "").encode().lower().split(), None]) for d, t, held in rows]
    counts = Counter(w for _, held, ws in split if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {d: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, _, ws in split}


def test_query_has_the_base_of_brute_force_and_beats_it(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in docs])
    got = op2_lm_scoring(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    print("held-out", sum(r.score for r in held), sum(r.base_score for r in held))


def test_bits_are_probabilities():
    rng = np.random.default_rng(1)
    code = Code(rng.integers(1, 400, 9))
    assert abs(sum(2.0 ** -code.lengths) - 1) < 1e-12
    words = rng.integers(0, 9, 3000).astype(np.uint64)
    seen = rng.integers(0, 9, 4000).astype(np.uint64)
    tables = [Table.chosen(Counts.of(n), 12) for n in gathered(seen, seen.astype(np.int64), np.array([0]))]
    model = Mixer(code, tables).fitted(words, words.astype(np.int64), np.array([3000]))
    history = list(range(5)) * 30
    total = 0.0
    before = model.bits(np.array(history, np.uint64), np.array(history), np.array([len(history)]))[0][0]
    for symbol in range(9):
        some = np.array([*history, symbol])
        total += 2.0 ** -(model.bits(some.astype(np.uint64), some, np.array([len(some)]))[0][0] - before)
    assert abs(total - 1) < 1e-3
    cost = lambda some: Mixer(code, tables).bits(some.astype(np.uint64), some, np.array([len(some)]))[0][0]
    assert cost(np.array(history)) < 0.8 * cost(rng.permutation(history))


def slow_bits(model, words, symbols):
    """The bits of one document, bit by bit, from the definition."""
    code, weights, cost = model.code, model.weights.astype(float).copy(), 0.0
    hashed = [[h] for h in zip(*contexts_of(words))]
    last, gradient = {}, np.zeros_like(weights)
    for t, symbol in enumerate(symbols.tolist()):
        if t % BLOCK == 0:
            weights, gradient = np.clip(weights + gradient, -LIMIT, LIMIT), np.zeros_like(weights)
        found = [tuple(int(x[0]) for x in table.found(np.array([h], np.uint64))) for table, h in zip(model.tables, hashed[t][0])]
        before = int(words[t - 1]) if t else None
        at = last.get(before, [])
        found.append((int(symbols[at[-1]]), 1 + (len(at) > 1 and words[at[-1]] == words[at[-2]])) if at else (0, 0))
        last.setdefault(before, []).append(t)
        for place in range(int(code.lengths[symbol])):
            own, levels = [float(code.stretched[code.offsets[symbol] + place])], []
            for k, (predicted, level) in enumerate(found):
                ahead = int(code.common(np.array([symbol]), np.array([predicted]))[0]) - place
                own.append(0.0 if level == 0 or ahead < 0 else float(model.strengths[k, level]) * (1 if ahead > 0 else -1))
                levels.append(level if ahead >= 0 else 0)
            gate = levels[1] + 4 * levels[2]
            z = float(np.clip(weights[gate] @ own, -30, 30))
            cost += np.log1p(np.exp(-z))
            gradient[gate] += RATE * np.array(own) / (1 + np.exp(z))
    return cost / np.log(2)


def contexts_of(words):
    from quillspark.llm.mixer import contexts

    return contexts(words, np.array([0]))


def test_bits_are_those_of_a_slow_scorer(monkeypatch):
    rng = np.random.default_rng(5)
    code = Code(rng.integers(1, 400, 40))
    seen = rng.choice(40, 6000, p=(p := rng.random(40) ** 4) / p.sum()).astype(np.uint64)
    model = Mixer(code, [Table.chosen(Counts.of(n), 10) for n in gathered(seen, seen.astype(np.int64), np.array([0]))])
    docs = [np.concatenate([seen[k : k + 90], rng.integers(0, 40, n).astype(np.uint64)]) for k, n in ((3, 1), (700, 300), (90, 40))]
    words, counts = np.concatenate(docs), np.array([len(d) for d in docs])
    got = model.bits(words, words.astype(np.int64), counts)[0]
    assert np.allclose(got, [slow_bits(model, d, d.astype(np.int64)) for d in docs], rtol=1e-4)
    monkeypatch.setattr("quillspark.llm.mixer.LOT", 70)
    assert np.allclose(got, model.bits(words, words.astype(np.int64), counts)[0], rtol=1e-6)


def test_spelling():
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(["th", "er", "on", "é", "ing"], rng.integers(1, 5))).encode() for _ in range(2000)})
    spelling = Spelling.learned(words)
    assert spelling.bits([b"therer"])[0] < spelling.bits([b"zqxwvk"])[0]


def test_counts_are_summed_exactly_and_pages_make_the_whole_table():
    rng = np.random.default_rng(3)
    numbers = (rng.integers(0, 1 << 12, 20000).astype(np.uint64) << np.uint64(40)) | rng.integers(0, 5, 20000).astype(np.uint64)
    whole = Counts.of(numbers)
    parts = [Counts.from_bytes(Counts.of(p).to_bytes()) for p in np.array_split(numbers, 7)]
    summed = Counts.summed(parts)
    assert (summed.numbers == whole.numbers).all() and (summed.counts == whole.counts).all() and whole.counts.sum() == 20000
    table = Table.chosen(whole, 8)
    cut = [Table.chosen(c, 8, 64 * k, 64) for k, c in enumerate(whole.cut(2))]
    for name in ("symbol", "mark"):
        assert (np.concatenate([getattr(t, name) for t in cut]) == getattr(table, name)).all()
    found = Counter(numbers.tolist())
    best = {}
    for number, n in found.items():
        context, symbol = number >> 16, number & 0xFFFF
        best[context] = max(best.get(context, (0, 0)), (n, symbol))
    slots = {}
    for context, (n, symbol) in best.items():
        slots[context >> 28] = max(slots.get(context >> 28, (0, 0, 0)), (n, context, symbol))
    assert all(table.symbol[k] == symbol and table.mark[k] & 3 == 1 + (n > 1) + (n > 3) for k, (n, _, symbol) in slots.items())
    assert Counts.summed([Counts.from_bytes(Counts.of(numbers[:0]).to_bytes())]).numbers.size == 0 and not Table.chosen(Counts.of(numbers[:0]), 3).mark.any()


def test_scores_do_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 10 == 0).alias("held_out"))
    one, two = (sorted((r.doc_id, r.score) for r in scored(docs.repartition(n)).collect()) for n in (3, 24))
    assert [d for d, _ in one] == [d for d, _ in two]
    assert np.allclose([x for _, x in one], [x for _, x in two], rtol=1e-5)


def test_odd_rows(spark):
    rows = [(1, None, False), (2, "", True), (3, "A b\x0ba", False), (3, "A b\x0ba", False), (None, "é " * 40000, None), (5, "zz q", True)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, held_out boolean, n_known int, word string")
    got = scored(docs).collect()
    want = brute([(k, t, bool(h)) for k, (_, t, h) in enumerate(rows)])
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted((*w[:3], round(w[3], 6)) for w in want.values())
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert scored(docs.limit(0)).count() == 0
    alone = scored(docs.filter("held_out")).collect()
    assert len(alone) == 2 and {r.train_tokens for r in alone} == {0} and all(r.n_known == 0 for r in alone)


def test_words_are_split_at_ascii_white_space():
    found = [" a\x0bB\r\n", "", "\x1c x\u00a0y \x85z", "É é\t\t"]
    codes, words, counts = split_words(pa.array(found))
    listed = words.to_pylist()
    assert [w.encode() for w in (listed[c] for c in codes)] == [w for t in found for w in t.encode().lower().split()]
    assert counts.tolist() == [len(t.encode().split()) for t in found]
    words, symbols, counts = Vocabulary({"a": 0}).laid(pa.array(["a b", ""]))
    assert symbols.tolist() == [0, 1, 2, 2] and counts.tolist() == [3, 1] and words[0] == 0


def test_spelling_and_weights_are_learned_from_all_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = sorted({w.decode() for r in docs.collect() for w in r.text.encode().lower().split()})
    want, got = Spelling.learned([w.encode() for w in words]), scoring.learned_spelling(spark.createDataFrame([(w,) for w in words], "word string").repartition(5))
    assert (got.table == want.table).all() and got.table[0].sum() > 0 and np.allclose(got.weights, want.weights)
    rows = docs.select("text", scoring.part().alias("part"))
    numbers = {w: k for k, w in enumerate(words[:300])}
    shared = spark.sparkContext.broadcast(Vocabulary(numbers))
    laid = [Vocabulary(numbers).laid(pa.array([r.text for r in rows.collect() if r.part == own])) for own in range(2)]
    tables, _ = scoring.context_tables(rows, shared, sum(len(x[0]) for x in laid))
    halves = [tables(own) for own in range(2)]
    for x, half in zip(laid, halves, strict=True):
        bits = len(half[0].symbol).bit_length() - 1
        for mine, numbered in zip(half, gathered(x[0], x[1], np.cumsum(x[2]) - x[2]), strict=True):
            alone = Table.chosen(Counts.of(numbered), bits)
            assert (mine.symbol == alone.symbol).all() and (mine.mark == alone.mark).all()
    code = Code(np.arange(1, 303))
    found = sum(Mixer(code, halves[1 - own]).observed(*laid[own]) for own in range(2))
    model, chance = scoring.fitted(rows.repartition(5), shared, Mixer(code, halves[0]), halves)
    alone = Mixer(code, halves[0]).fitted_to(found)
    assert (model.weights == alone.weights).all() and (model.strengths == alone.strengths).all() and 0 < chance < 1
    assert found[:-2].sum() == sum(code.lengths[x[1]].sum() for x in laid)  # every bit of every document


def test_frequent_words_are_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SYMBOLS", 7)
    rows = [(f"w{k}", 1000 + k // 2) for k in range(30)] + [("most", 5000), ("never", 0)]
    found = scoring.frequent_words(spark.createDataFrame(rows, "word string, c long"))
    assert [r.c for r in found] == [5000, 1014, 1014, 1013, 1013, 1012, 1012]
    monkeypatch.setattr(scoring, "SYMBOLS", 4)
    assert [r.c for r in scoring.frequent_words(spark.createDataFrame(rows, "word string, c long"))] == [5000, 1014, 1014, 1013]


def test_a_fit_counts_each_bit_in_its_cell_and_lays_out_like_tokens_once(monkeypatch):
    rng = np.random.default_rng(6)
    code = Code(rng.integers(1, 400, 40))
    seen = rng.choice(40, 6000, p=(p := rng.random(40) ** 4) / p.sum()).astype(np.uint64)
    model = Mixer(code, [Table.chosen(Counts.of(n), 10) for n in gathered(seen, seen.astype(np.int64), np.array([0]))])
    words, counts = np.concatenate([seen[:300], rng.integers(0, 40, 60).astype(np.uint64)]), np.array([300, 0, 60])
    want, symbols, starts = Counter(), words.astype(np.int64), np.cumsum(counts) - counts
    found = model.predictions(words, symbols, starts, np.repeat(np.arange(3), counts))[0]
    for t, symbol in enumerate(symbols.tolist()):
        for place in range(int(code.lengths[symbol])):
            cell = (int(np.clip(np.rint(code.stretched[code.offsets[symbol] + place] * BINS_A_UNIT), -REACH * BINS_A_UNIT, REACH * BINS_A_UNIT)) + REACH * BINS_A_UNIT) * ALL_STATES
            for (common, level), step in zip(found, STEPS, strict=True):
                ahead, value = int(common[t]) - place, int(level[t])
                cell += 0 if value == 0 or ahead < 0 else step * (2 * value - (ahead == 0))
            want[cell] += 1
    laid, real = [], Mixer.laid_out
    monkeypatch.setattr(Mixer, "laid_out", lambda self, symbols, *rest: laid.append(len(symbols)) or real(self, symbols, *rest))
    once = model.observed(words, symbols, counts)
    assert {k: n for k, n in enumerate(once[:CELLS].tolist()) if n} == want
    tokens = sum(laid)
    laid.clear()
    assert 0 < tokens <= len(words)
    assert (model.observed(np.tile(words, 50), np.tile(symbols, 50), np.tile(counts, 50)) == 50 * once).all()
    assert sum(laid) == tokens  # copies cost no more than one text


def test_order_is_stable_also_where_high_bits_are_equal():
    rng = np.random.default_rng(7)
    for keys in (rng.integers(0, 1 << 63, 999).astype(np.uint64) << np.uint64(1), rng.integers(0, 50, 999).astype(np.uint64), np.zeros(0, np.uint64)):
        keys = np.concatenate([keys, keys])
        assert (ordered(keys) == np.argsort(keys, kind="stable")).all()


def test_words_are_spelled_alike_as_a_list_and_as_a_column():
    words = ["a", "", "é", "therer", "\U0001f600z"] * 3
    spelling = Spelling.learned([w.encode() for w in words])
    assert np.isfinite(want := spelling.bits([w.encode() for w in words])).all()
    column = pa.array(["left out", *words]).slice(1)
    assert (spelling.bits(column) == want).all() and (Spelling.learned(column).table == spelling.table).all()
    assert np.allclose(want, [spelling.bits([w.encode()])[0] for w in words]) and not len(spelling.bits([]))
