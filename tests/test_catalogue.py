"""Every registered query of the engine against DuckDB, and entry points."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from emberlog import catalogue

from oracle import connect, same

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), connect(sf_dir), catalogue.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() >= 0


def test_imports_without_the_optional_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("emberlog.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries()) and "search_combined" in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_other_import_errors_are_not_hidden():
    code = """
import sys
class Broken:
    def find_spec(self, name, path=None, target=None):
        if name == "emberlog.operators.rollups":
            raise ImportError("broken on purpose")
sys.meta_path.insert(0, Broken())
try:
    import __spark_entry__
except ImportError as e:
    assert "on purpose" in str(e)
else:
    raise SystemExit("hidden")
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
