"""The driver contract, and that the rest stands without the text subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_belongs_to_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())
    assert all(text.strip().upper().startswith(("SELECT", "WITH")) for text in sql.values())


def test_the_flagship_query_has_rows(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["amount_cents"] >= rows[-1]["amount_cents"]


def test_the_rest_imports_without_the_text_subpackage(tmp_path):
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(here)})
    assert found.returncode == 0, found.stderr
    count, text = found.stdout.split()[-2:]
    assert int(count) > 90 and text == "False"
