"""The driver's contract, and that everything but the training-data subpackage works without it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

from tests.conftest import SMALL

REPO = Path(__file__).resolve().parent.parent


def test_entry_gives_revenue_of_regions(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["revenue"] > 0 for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_relational_queries_match_sql(spark, same_rows):
    from quern.plans import relational

    for name, sql in relational.ORACLES.items():
        same_rows(relational.QUERIES[name](spark, SMALL), sql)


def test_imports_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "quern.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "revenue_by_region" in e.queries() and not any(k.startswith("op") for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, env=os.environ | {"PYTHONPATH": str(REPO)}, check=True, timeout=120)


def test_imports_with_an_empty_subpackage_folder(tmp_path):
    """What is left of a folder once its sources are deleted."""
    import shutil

    for name in ("__spark_entry__.py", "quern"):
        source = REPO / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    for made in (False, True):
        if made:
            (tmp_path / "quern/llm/__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.llm is None and 'revenue_by_region' in e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
