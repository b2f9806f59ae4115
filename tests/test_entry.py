"""The entry module: names, columns, and that it stands without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

REPO = Path(entry_module.__file__).parent


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 80


@pytest.mark.parametrize("kept", ["neither", "pipeline", "empty folder"])
def test_entry_stands_without_the_subpackage(tmp_path, kept):
    copy = tmp_path / "repo"
    gone = ["llm"] + ["corpus_pipeline.py"] * (kept == "neither")
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
    if kept == "empty folder":
        (copy / "quillspark" / "llm").mkdir()
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, check=True)
    n, has, fit = done.stdout.split()
    assert int(n) > 60 and (has, fit) == ("False", "True")


def test_entry_needs_none_of_sparks_jars():
    """Where pyspark lies apart from Spark's jars, all queries are there all the same."""
    code = "import sys, pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'; import __spark_entry__ as e; print(len(e.queries()), 'pyspark.ml' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120, check=True)
    n, ml = done.stdout.split()
    assert int(n) > 80 and ml == "False"
