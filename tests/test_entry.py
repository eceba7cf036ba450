"""The driver's contract, with and without the corpus package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout.split()


def test_without_the_corpus_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    left = names(str(tmp_path / "r"))
    assert "knn_filtered" in left and not any(n.startswith("op") for n in left) and "pipeline" not in left


def test_names():
    assert "knn_filtered" in names(ROOT)
