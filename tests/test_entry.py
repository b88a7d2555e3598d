"""The driver contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "id", "score", "pos"} <= set(rows[0].asDict())


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n[:2] == 'op' and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, *rest = said.stdout.split()
    assert int(n) > 100 and rest == ["False", "False", "True"]
