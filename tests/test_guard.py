"""The rest works without the training-data subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_without_llm(tmp_path):
    shutil.copytree(REPO / "gridstone", tmp_path / "gridstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'vec_dot_product' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for path in REPO.glob("gridstone/**/*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "gridstone.llm" not in path.read_text(), path
