"""The driver contract with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
import tempfile

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_without_training_data_operators():
    """A copy without the two folders, with and without the pipeline's file, still has the
    other queries."""
    copy = tempfile.mkdtemp(prefix="spark-copy-")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", copy)
    shutil.copytree(f"{ROOT}/tileframe", f"{copy}/tileframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    want = f"{sum(not n.startswith('op') and n != 'pipeline' for n in __spark_entry__.queries())} False"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            if os.path.exists(f"{copy}/{name}"):
                os.remove(f"{copy}/{name}")
        run = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": copy}, capture_output=True, text=True)
        assert run.returncode == 0, run.stderr
        assert run.stdout.strip() == want
