import re

import pytest

from quillspark.llm.licenses import PHRASES, TEMPLATES, Automaton, op10_licenses, scanned, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def accepted(automaton, text):
    words = words_of(text)
    return max((automaton.share(words, k) for k in range(len(words))), default=0.0)


def test_query_has_the_base_of_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    got = op10_licenses(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == len(docs)
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id]) for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    labels = {x for r in got for x in r.labels.split(",")}
    assert {"apache-2.0", "gpl-3.0", "cc-by-nc-4.0"} <= labels or not any(r.n_base for r in got)


def test_templates():
    a = Automaton.compiled("copyright {{3}} by the [[kind]] holder [[of [[all]] rights]] ok")
    for good in ("copyright by the holder ok", "Copyright 2020 A B by the kind holder. OK", "copyright x by the holder of rights ok", "copyright by the holder of all rights ok"):
        assert accepted(a, "before " + good + " after") == 1.0
    for bad in ("copyright a b c d by the holder ok", "copyright by holder ok", "copyright by the kind kind holder ok", "copyright by the holder of all ok"):
        assert accepted(a, bad) < 1.0
    assert all(accepted(Automaton.compiled(t), re.sub(r"\{\{\d+\}\}", "x", t)) == 1.0 for t in TEMPLATES.values() if "[[" not in t)
    for wrong in ("[[a]] b", "a [[b", "", "{{2}} a"):
        with pytest.raises(ValueError):
            Automaton.compiled(wrong)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "MIT-License mit LICENSE; cc by cc by"), (3, "MIT-License mit LICENSE; cc by cc by"), (None, "é" * 10 + " gnu general\npublic\tlicense"), (4, "word " * 60000 + "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, labels string, score double")
    got = scanned(docs).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted((repr(d), *brute(t)) for d, t in rows)
    assert [r.labels for r in got if r.doc_id == 4] == ["mit"] and [r.score for r in got if r.doc_id == 4] == [1.0]
    assert scanned(docs.limit(0)).count() == 0


def test_scores_of_starts_without_the_rest(spark):
    starts = {"mit-text": 17, "bsd-clauses": 10, "isc": 5}
    rows = [(k, "before " + " ".join(TEMPLATES[label].split()[:n]) + " after") for k, (label, n) in enumerate(starts.items())]
    got = {r.doc_id: r for r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, n) in enumerate(starts.items()):
        assert got[k].labels == "" and abs(got[k].score - n / len(TEMPLATES[label].split())) < 1e-9
