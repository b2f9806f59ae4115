import hashlib
import random

import numpy as np

from quillspark.llm.parsing import fingerprinted, likeness, op3_fingerprints, signatures, written_out

SF = "/root/testdata/sf0.1"


def brute(rows):
    """doc_id: (n_chars, edited_sha256, edited text, next text), for rows in order."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, after))
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute(sorted(((r.doc_id, r.text or "") for r in docs), reverse=True))
    got = {r.doc_id: r for r in op3_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs) == len(want)
    texts = {r.doc_id: r.text or "" for r in docs}
    for doc_id, n, sha, edited, after in want[:: 7]:
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        one, two, three = (signatures([t]) for t in (texts[doc_id], edited, after))
        assert [r.fingerprint, r.edited_fingerprint] == written_out(np.concatenate([one, two]))
        assert (r.near_edited, r.near_next) == (likeness(one, two)[0], likeness(one, three)[0])
    by = {}
    for r in got.values():
        assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in got.values() if r.n_chars > 2000]
    assert 0.2 < sum(r.near_edited for r in long) / len(long) < 0.5
    assert sum(r.near_next for r in long) / len(long) < 0.1


def test_shifted_and_embedded_texts_stay_alike():
    rng = random.Random(1)
    for letters in ("abcdefgh ", "ab", "éßж中 "):
        text = "".join(rng.choices(letters, k=6000))
        one, two, three, four = signatures([text, "xyz" + text, text[:3000] + "!" + text[3000:], "".join(rng.choices(letters, k=6000))])
        alike = lambda a, b: likeness(a[None], b[None])[0]
        assert alike(one, two) > 0.9 and alike(one, three) > 0.9 and alike(one, four) < 0.35
        assert (signatures([text])[0] == one).all()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "b" * 50000), (3, "b" * 50000), (None, "ab"), (None, "aab𝄞"), (2**62, "z" * 9 + "é" * 9)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, bucket string").repartition(3)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = [r[:3] for r in brute(order)]
    got = [tuple(r)[:3] for r in fingerprinted(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert fingerprinted(docs.limit(0)).count() == 0
    one = fingerprinted(docs.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_largest_and_smallest_ids(spark):
    ids = [2**63 - 1, 2**63 - 2, -(2**63) + 1, 0, 5]
    docs = spark.createDataFrame([(k, f"text of {k} " * 9) for k in ids], "doc_id long, text string")
    want = {r[0]: r[2] for r in brute(sorted(((k, f"text of {k} " * 9) for k in ids), reverse=True))}
    assert {r.doc_id: r.edited_sha256 for r in fingerprinted(docs).collect()} == want
