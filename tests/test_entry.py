"""The driver's way in, with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_queries(spark):
    import __spark_entry__ as way_in

    queries, sql = way_in.queries(), way_in.oracle_sql()
    assert set(sql) <= set(queries)
    first = way_in.entry(spark)
    assert first.count() >= 0 and first.columns


def test_imports_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
