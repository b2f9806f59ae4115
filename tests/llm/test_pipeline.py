import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillspark.llm import decontaminate, neardup
from quillspark.llm.neardup import near_duplicates, slice_counts
from quillspark.llm.tokens import public_vocabulary

SF = "/root/testdata/sf0.01"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_near(rows, similarity=0.8):
    """doc_ids that stay, of rows with distinct ids."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for found in where.values() for a in found for b in found if a < b}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), doc_id), doc_id)
    return sorted(best.values())


def test_near_duplicates_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_near([(r.doc_id, r.text) for r in docs.collect()])
    got = near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == want


def test_near_duplicates_of_planted_copies(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    rows, k = [], 0
    for n in (3, 6, 12, 25, 40, 63, 90, 127, 128, 200, 255, 257, 500, 1100):
        for _ in range(4):
            base = rng.choices(words, k=n)
            for _ in range(rng.randint(1, 4)):
                copy = list(base)
                for _ in range(n // 60):
                    copy[rng.randrange(n)] = rng.choice(words)
                rows.append((k, " ".join(copy + rng.choices(words, k=rng.choice([0, 0, max(1, n // 30)])))))
                k += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    got = sorted(r.doc_id for r in near_duplicates(docs).collect())
    assert set(want) <= set(got) and len(got) <= len(want) + 1
    for n in range(1, 3000):
        assert all(set(slice_counts(n)) & set(slice_counts(m)) for m in range(-(-n * 8 // 10), n))


def test_near_duplicates_of_hubs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for n in (300, 50):
        base = rng.choices(words, k=200)
        rows.append(" ".join(base))
        for _ in range(n):
            copy = list(base)
            for at in rng.sample(range(200), 4):
                copy[at] = rng.choice(words)
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    want = brute_near(rows)
    got = sorted(r.doc_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and len(want) == 2


def test_near_duplicates_of_long_copies_compare_few_texts(spark, monkeypatch):
    """Copies of a long text share most slices with each other; few of these pairs are needed to join them."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base, rows = rng.choices(words, k=2000), []
    for k in range(300):
        copy = list(base)
        for at in rng.sample(range(2000), rng.randint(1, 30)):
            copy[at] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    counts, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *more: counts.append(pairs.count()) or verified(pairs, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in near_duplicates(docs).collect()] == brute_near(rows) == [0]
    assert sum(counts) < 8 * len(rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (4, "A b c d e  f"), (4, "A b c d e  f"), (4, "q r s"), (None, "zz"), (5, "x " * 30000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, id int, same string")
    got = near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").strip()[:3]) for r in got) == [(False, 1, ""), (False, 4, "A b"), (False, 4, "q r"), (False, 5, "x x"), (True, 0, "zz")]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        path = cp.new_path(spark, f"test-{name}")
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    texts = {r.text for r in docs.collect()}
    passages = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(p in t for t in texts for p in passages)
    assert 950 < counts[0] <= 1000 and counts[1] < counts[0] and counts[2] < counts[1]
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[-1]


def brute_mix(rows):
    """Rows (doc_id, source, text) as often as systematic sampling takes them, by the definition."""
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r[1] for r in rows if r[1] is not None}, key=lambda s: s.encode()) + ([None] if any(r[1] is None for r in rows) else [])
    sizes = {s: sum(size(r[2]) for r in rows if r[1] == s) for s in sources}
    weights = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    left, opened, targets = 1.5 * sum(sizes.values()), set(sources), {}
    while True:
        level = left / sum(weights[s] for s in opened)
        over = [s for s in opened if weights[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
            opened.remove(s)
    targets |= {s: weights[s] * level for s in opened}
    out = []
    for s in sources:
        key = "~" if s is None else "s" + s
        offset = int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:8], 16) / 4294967296.0
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (size(r[2]), r[0]))
        for k, r in enumerate(own):
            out += [r] * int(math.floor((k + 1) * rate + offset) - math.floor(k * rate + offset))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    """The whole pipeline over whole texts: the language of each document by the operator that has a test of its own, the
    other stages by their definitions."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.language(spark, documents, SF).select("doc_id", "source", "text").collect()
    rows = {r.doc_id: (r.doc_id, r.source, r.text) for r in kept}
    stay = brute_near([(r[0], r[2]) for r in rows.values()])
    some = spark.createDataFrame([(d, rows[d][2]) for d in stay], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", some.toPandas())
    con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    leaked = {r[0] for r in con.sql(decontaminate.ORACLE["op6_decontaminate"]).fetchall()}
    mix = sorted(brute_mix([rows[d] for d in stay if d not in leaked]), key=lambda r: r[0])
    tokenizer = Tokenizer.from_file(public_vocabulary())
    want, at = [], 0
    for doc_id, _, text in mix:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = cp.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 500


CLASHING = "lang_pred string, score string, rejected string, target string, copies string, source_size string, words string, row string, size string, h string"


@pytest.mark.parametrize("name", [name for name, _ in cp.STAGES[:-1]])
def test_stages_take_odd_rows_and_clashing_columns(spark, name):
    text = " ".join(["the cat and the dog went out to see what there was of the day"] * 3)
    long = " ".join(f"the word{k} of and the" for k in range(40_000))
    given = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (3, "", None, "b"), (None, text + " or night", "en", None), (4, long, "en", "b"), (5, text, "en", "a"), (6, "12 !", "en", "a")]
    docs = spark.createDataFrame([(*r, *[f"own {k}"] * 10) for k, r in enumerate(given)], "doc_id long, text string, lang string, source string, " + CLASHING)
    got = dict(cp.STAGES)[name](spark, docs, SF)
    assert got.schema.simpleString() == docs.schema.simpleString()
    rows = got.collect()
    known = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in known for r in rows)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    if name == "language":
        assert ids == [(False, 1), (False, 1), (False, 4), (False, 5), (True, 0)]
    elif name == "near_dedup":
        assert ids == [(False, 1), (False, 2), (False, 4), (False, 6)]
    elif name == "decontamination":
        assert len(ids) == 8
    else:
        assert all(ids.count(i) <= 4 for i in ids) and (False, 4) in ids


@pytest.mark.parametrize("name", [name for name, _ in cp.STAGES])
def test_stages_take_empty_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(cp.STAGES)[name](spark, docs, SF).count() == 0
