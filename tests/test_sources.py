"""Exports, id lists, search terms and settings."""

import dataclasses
import json
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators.store import run_id
from quillspark.sources import collect, config, export

OK = """1. J Neurosci. 2019 Mar 5;39(10):1-12. doi: 10.1/abc.

Cerebellar control of timing in mice:
a study.

Smith JA(1), Müller B(2).

Author information:
(1)Department of Neurology, University of X, Paris, France.
(2)Institute of Y, Germany.

BACKGROUND: Timing needs the cerebellum. METHODS: We recorded cells in mice.
RESULTS: Cells fired early. CONCLUSION: it is plain text.

Copyright 2019 The Authors.

DOI: 10.1/abc
PMID: 111

2. Brain. 2020.

Another article

Conflict of interest statement: none

PMID: 222

3. Cortex. 2021 Jan;5:1.

No id here but text about brains that goes on.
"""


def test_export_blocks(spark):
    texts = spark.createDataFrame([(OK,)], "value string")
    assert export.blocks(texts).count() == 3
    rows = export.parsed(texts, 2027).collect()
    assert [(r.pmid, r.year, r.doi) for r in rows] == [("111", 2019, "10.1/abc")]
    assert rows[0].title == "Cerebellar control of timing in mice: a study."
    assert "Smith" not in rows[0].abstract and "Copyright" not in rows[0].abstract and "Timing needs" in rows[0].abstract


def sections_of(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(export.sections("t").alias("s")).first().s
    return [(s.content, s.bucket, s.section) for s in found]


def test_block_numbers_are_no_years(spark):
    block = "{n}. J Test. {year} Mar 5;1(2):3-4.\n\nA title of some article.\n\nMemory depends on sleep in many ways.\n\nPMID: {n}\n"
    texts = spark.createDataFrame([("\n\n".join(block.format(n=n, year=year) for n, year in ((1999, 2011), (2000, 2012), (2026, 2013), (2027, 2014))),)], "value string")
    assert {r.pmid: r.year for r in export.parsed(texts, 2026).collect()} == {"1999": 2011, "2000": 2012, "2026": 2013, "2027": 2014}


def test_sections(spark):
    found = sections_of(spark, "Some start. OBJECTIVES: to see; RESULTS: seen. SIGNIFICANCE: much. METHODS: none CONCLUSION: x")
    assert [s[1:] for s in found] == [(None, None), ("question", "OBJECTIVES"), ("results", "RESULTS"), ("results", "METHODS")]
    assert found[-1][0] == "none CONCLUSION: x"
    assert sections_of(spark, "no headers") == [("no headers", None, None)] and sections_of(spark, " ") == sections_of(spark, None) == []
    assert sections_of(spark, "Some words\nMETHODS:\nRESULTS: a  b") == [("Some words", None, None), ("a b", "results", "RESULTS")]


def cleaned(spark, text, title=None):
    return spark.createDataFrame([(text, title)], "t string, n string").select(export.cleaned_abstract("t", "n").alias("c")).first().c


def test_cleaned(spark):
    assert cleaned(spark, "A title of some length\nwe found cells\n\n\nwrite to x@y.org\nPMID: 3", "A title of some length") == "we found cells"
    assert cleaned(spark, "First\r\n\n\nSecond part\nAuthor information:\n(1)Dept of X\nThird\nCopyright 2020\nFourth") == "First Second part\nThird"
    assert cleaned(spark, None) == cleaned(spark, "") == cleaned(spark, "Smith JA(1), Lee B(2).") == ""


def test_blocks_without_title_take_the_first_line(spark):
    block = "1. J X. 2019 Mar.\n\n2019 Mar eCollection\n\nLee B(2).\n\nA first line\nand a second"
    got = spark.createDataFrame([(block,), (None,)], "b string").select(export.parsed_block("b").alias("p")).collect()
    assert tuple(got[0].p) == ("A first line", "and a second") and tuple(got[1].p) == ("", "")


def test_runs_of_names_have_no_bound(spark):
    from quillspark.functions.lines import is_metadata

    rows = [("Smith " * 60 + "AB",), (" ".join(["Smith"] * 60) + "(1)",), ("Smith " * 5000 + "went on",)]
    got = spark.createDataFrame(rows, "t string").select(is_metadata(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == [True, True, False]


@pytest.mark.parametrize("text", ['["1", "2"]', '[{"pmid": "1"}, {"pmid": "2"}]', '{"pmids": ["1", "2"]}', '{"samples": [{"pmid": "2"}, {"pmid": "1"}]}', "1 # one\n\n# none\n2\n"])
def test_id_lists(spark, tmp_path, text):
    (tmp_path / "ids").write_text(text)
    assert sorted(r.pmid for r in export.read_ids(spark, str(tmp_path / "ids")).collect()) == ["1", "2"]


def test_bad_id_list(spark, tmp_path):
    (tmp_path / "ids").write_text(json.dumps({"other": 1}))
    with pytest.raises(Exception, match="not an id list"):
        export.read_ids(spark, str(tmp_path / "ids")).collect()


def test_search_terms():
    what = collect.Collect()
    assert collect.search_term(what, 2020, 2) == '(Neurosciences[MeSH Terms]) NOT review[pt] AND ("2020/02/01"[PDAT] : "2020/02/29"[PDAT])'
    assert "NOT review" not in collect.search_term(collect.Collect(term="systematic review"))
    assert collect.search_term(what, 2024).endswith('AND ("2024/01/01"[PDAT] : "2024/12/31"[PDAT])')
    with pytest.raises(ValueError):
        collect.search_term(what, month=3)


class FakeClient:
    """Three articles a month in 2019 and 2020; of each search the first try fails."""

    tried: set = set()

    def ids(self, term):
        first, last = re.findall(r'"(\d{4}/\d{2}/\d{2})"', term)
        return [f"{y}{m:02d}{n}" for y in (2019, 2020) for m in range(1, 13) for n in range(3) if first <= f"{y}/{m:02d}/{n + 1:02d}" <= last]

    def search(self, term, start, limit):
        if (term, start, limit) not in self.tried:
            self.tried.add((term, start, limit))
            return "<html>busy</html>"
        found = self.ids(term)
        return json.dumps({"esearchresult": {"idlist": found[start : start + min(limit, 5)], "count": str(len(found))}})

    def fetch(self, ids):
        return "\n\n".join(f"1. J X. {i[:4]} Mar.\n\nTitle of {i}\n\n{'We looked at cells of ' + i if i[-1] != '2' else ''}\n\nDOI: 10.1/{i}\nPMID: {i}" for i in ids)

    def cited(self, pmid, doi):
        return None if pmid.endswith("0") else int(pmid[-1]) + len(doi)


def test_search_source_pages_through_stretches(spark):
    what = collect.Collect(year_from=2019, year_to=2020)
    df = collect.found_ids(spark, what, "test_sources:FakeClient", 0.0)
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r.year, r.pmid) for r in df.collect()) == sorted((y, f"{y}{m:02d}{n}") for y in (2019, 2020) for m in range(1, 13) for n in range(3))
    count = lambda term: len(FakeClient().ids(term))
    assert len(collect.stretches(what, count, 36)) == 2 and len(collect.stretches(what, count, 10)) == 24
    days = collect.stretches(what, count, 1)
    assert len(days) == 731 and sum(count(term) for _, term in days) == 72
    with pytest.raises(RuntimeError, match="more than 0 results on 2019-01-01"):
        collect.stretches(what, count, 0)


def test_errors_of_a_service_are_raised():
    class Broken:
        def search(self, term, start, limit):
            return json.dumps({"esearchresult": {"ERROR": "no such field"}})

        def fetch(self, ids):
            raise OSError("no route")

    with pytest.raises(RuntimeError, match="no such field"):
        collect.found_page(Broken(), "x", 0, 1, 0.0)
    with pytest.raises(OSError, match="no route"):
        collect.retried(Broken().fetch, ["1"], wait=0.0)
    with pytest.raises(RuntimeError, match="not accepted"):
        collect.retried(lambda: "", wait=0.0)


@dataclasses.dataclass
class Inner:
    x: int = 1


@dataclasses.dataclass
class Outer:
    name: str = ""
    inner: Inner = dataclasses.field(default_factory=Inner)


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "here")
    (tmp_path / "c.yaml").write_text("name: $PLACE/x\ninner: {x: 3}\n")
    assert config.loaded(Outer, str(tmp_path / "c.yaml")) == Outer("here/x", Inner(3))
    with pytest.raises(ValueError):
        config.built(Outer, {"other": 1})


def test_years(tmp_path):
    assert config.test_years([2020, 2021, 2022], [2021, 2030]) == [2021]
    assert config.test_years([2020, 2021], [2030], compat=True) == [2021] and config.test_years([2020], [2030], compat=True) == [2020]
    with pytest.raises(ValueError):
        config.test_years([2020], [2030])
    assert config.benchmark_years([2021, 2023, 2024], [2023, 2024, 2025], 2022) == [2023, 2024]
    with pytest.raises(RuntimeError):
        config.benchmark_years([2021], [2023], 2022)
    for name in ("year_max_2022/lora", "year_max_2020/lora", "year_max_2019", "other/lora"):
        (tmp_path / name).mkdir(parents=True)
    assert config.adapter_years(str(tmp_path)) == [2020, 2022]


def test_run_id():
    from datetime import datetime

    assert run_id("predict", datetime(2024, 1, 2, 3, 4, 5)) == "predict_20240102T030405Z"


def test_sections_and_exports_take_whole_texts(spark, tmp_path):
    from quillspark.plans.language_models import parse_export, parse_sections

    given = ["The brain learns", "we used slices", "neurons fired", "they fired again", "", "and went on firing"]
    rows = [(1, "\n".join(given)), (2, "\n".join(given[:2])), (3, "alone"), (4, "a\nb\nc"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.n_results) for r in parse_sections(spark, str(tmp_path)).collect()}
    assert got == {1: (3, len("we used slices neurons fired they fired again and went on firing")), 2: (2, 14), 3: (1, 0), 4: (3, 3), 5: (0, 0)}
    found = {r.pmid: r.n_chars for r in parse_export(spark, str(tmp_path)).collect()}
    assert found["1"] == len(" ".join(given).replace("  ", " ")) and found["2"] == len(" ".join(given[:2]))
