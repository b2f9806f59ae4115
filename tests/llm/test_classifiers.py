import random

from pyspark.sql import functions as F

from quillspark.llm.compression import drawn
from quillspark.llm.language import Languages, identified, op9_language
from quillspark.llm.quality import Quality, op7_quality, rated

SF = "/root/testdata/sf0.1"


def test_language_accuracy_on_held_out_documents(spark):
    got = op9_language(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    held = got.filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    print("accuracy", right[0])
    assert right[0] > 0.98 and 0 <= right[1] and right[2] <= 1


def test_quality_accuracy_on_held_out_documents(spark):
    got = op7_quality(spark, SF)
    held = got.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / len(good) / len(bad) > 0.97
    assert abs(sum(r.score for r in held) / len(held) - len(good) / len(held)) < 0.05


def odd(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 + 34", None), (4, "the cat and the dog " * 40, "en"), (4, "the cat and the dog " * 40, "en"), (None, "le chat et la souris " * 40, "fr"), (5, "le chat et la souris " * 9000, "fr")]
    return spark.createDataFrame([(*r, 9, "old") for r in rows], "doc_id long, text string, lang string, score int, predicted string")


def test_odd_rows(spark):
    docs = odd(spark)
    found = {(r.doc_id, r.text): r for r in identified(docs, Languages.learned(docs)).collect()}
    by = {k[0]: r for k, r in found.items()}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(by[k].rejected for k in (1, 2, 3))
    assert by[4].lang_pred == "en" and by[5].lang_pred == "fr" and by[None].lang_pred == "fr" and not by[5].rejected
    assert identified(docs, Languages.learned(docs.limit(0))).filter("lang_pred = 'und' and rejected").count() == 7
    assert identified(docs.limit(0), Languages.learned(docs)).count() == 0
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (77, 1), (3, 7)], "doc_id long, quality int")
    quality = Quality.learned(docs, labels)
    got = {r.doc_id: r for r in rated(docs, quality).collect()}
    assert got[4].score > got[5].score and got[1].score == got[2].score and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got.values())
    constant = Quality.learned(docs, labels.limit(0))
    assert {r.score for r in rated(docs, constant).collect()} == {0.5}
    assert rated(docs.limit(0), quality).count() == 0


def test_drawn_is_bounded_and_repeatable(spark):
    rng = random.Random(2)
    rows = [(i, "abc"[min(2, rng.randrange(9))]) for i in range(5000)] + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    one = sorted(map(tuple, drawn(df, "label", F.col("doc_id"), 40).collect()))
    assert one == sorted(map(tuple, drawn(df.repartition(7), "label", F.col("doc_id"), 40).collect()))
    assert len(one) == 120


def test_drawn_takes_repeated_rows_once(spark):
    rows = [(k % 3, f"text {k % 3}", "copies") for k in range(10000)] + [(k, f"other {k}", "many") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = drawn(df, "label", F.struct("doc_id", "text"), 250).collect()
    assert sorted(r.text for r in got if r.label == "copies") == ["text 0", "text 1", "text 2"] and len(got) == 253


def test_only_letters_count_as_letters(spark):
    docs = odd(spark).select("doc_id", "text", "lang")
    more = spark.createDataFrame([(k, t) for k, t in enumerate(["½ ²", "x", "٣ ५", "_ Ⅷ", "ª"])], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in identified(more, Languages.learned(docs)).collect()}
    assert got[0] == got[2] == got[3] == "und" and got[1] != "und" and got[4] != "und"


def test_language_equals_a_loop_over_rows(spark):
    """Sizes of each whole text under each dictionary, with the library's defaults made explicit."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    languages = Languages.learned(docs)
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in identified(docs, languages).collect()}
    for doc_id, text in rows:
        data = b" ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).encode().split())
        if not data:
            assert got[doc_id] == ("und", True)
            continue
        sizes = []
        for lang, content in languages.contents:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size = 0
            for level, parts in ((6, [data[k : k + 2048] for k in range(0, len(data), 2048)]), (12, [data[k + 1 : 100] for k, c in enumerate(data[:100]) if c == 32])):
                parameters = dict(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
                size += sum(len(zstandard.ZstdCompressor(**parameters).compress(p)) for p in parts)
            sizes.append((size, lang))
        best, second = sorted(sizes)[:2]
        assert got[doc_id] == (best[1], 1 - best[0] / second[0] < 0.01), (doc_id, sizes)


def test_quality_equals_a_loop_over_rows(spark):
    import zstandard
    from math import exp, log

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    quality = Quality.learned(docs, labels)
    got = {r.doc_id: r.score for r in rated(docs.filter("doc_id % 7 = 0"), quality).collect()}
    rows = docs.filter("doc_id % 7 = 0").select("doc_id", "text").collect()
    plain = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    kind = lambda trained: zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    bad, good = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=kind(t)), **plain) for c, t in (quality.bad, quality.good))
    for doc_id, text in rows:
        data = (text or "").encode()
        saved = sum(len(bad.compress(data[k : k + 512])) - len(good.compress(data[k : k + 512])) for k in range(0, len(data), 512))
        x = (saved / len(data), log(len(zstandard.ZstdCompressor(**plain).compress(data)) / len(data))) if data else (0.0, quality.typical)
        want = 1 / (1 + exp(-(quality.curve[0] * x[0] + quality.curve[1] * x[1] + quality.curve[2])))
        assert abs(got[doc_id] - want) < 1e-9


def test_repeated_documents_are_learned_from_once(spark):
    docs = spark.createDataFrame([(k % 40, f"{'good words here' if k % 2 else 'bad junk x'} {k % 40} " * 20) for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    once = Quality.learned(docs.dropDuplicates(["doc_id"]), labels)
    assert Quality.learned(docs, labels) == once
