import random

import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.components import components


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    runs = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64(b" ".join(r), seed=42).intdigest() for r in runs if r]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    ids = [r.doc_id for r in docs]
    want = [(d, f"{fp:016x}", ids[g]) for d, fp, g in zip(ids, fps, brute_groups(fps))]
    assert sorted(map(tuple, simhash.op4_simhash(spark, "/root/testdata/sf0.01").collect())) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (None, "a b"), (7, "A  B"), (6, "a"), (6, "a b c d"), (None, "zz yy xx ww vv")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert {found[(d, "0" * 16)] for d in (1, 2, 3)} == {1}
    ab = f"{brute_fingerprint('a b'):016x}"
    assert found[(7, ab)] == 7 and found[(None, ab)] == 7
    assert found[(None, f"{brute_fingerprint('zz yy xx ww vv'):016x}")] is None
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_links_with_crowded_cells_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    centre, fps = rng.getrandbits(64), {0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 63)}
    for _ in range(150):
        x = centre
        for _ in range(rng.choice([1, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    while len(fps) < 330:
        x = rng.getrandbits(64)
        fps |= {x, x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), x ^ (1 << rng.randrange(64))}
    fps = sorted(fps)
    for most in (1, 4, 10_000):
        monkeypatch.setattr(simhash, "CELL_MOST", most)
        df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
        roots = {r.node % 2**64: r.root % 2**64 for r in components(simhash.links(df)).collect()}
        mine = {}
        for x in fps:
            mine.setdefault(roots.get(x, x), set()).add(x)
        want = {}
        for x, g in zip(fps, brute_groups(fps)):
            want.setdefault(g, set()).add(x)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    found = {r.node: r.root for r in components(edges.union(edges)).collect()}
    assert found == {**dict.fromkeys(range(n), 0), 2000: 2000, 2001: 2000}
    assert components(edges.limit(0)).select(F.count("*")).first()[0] == 0
