"""The registry with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


def test_the_rest_works_without_them(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = run(tmp_path, COUNT)
    assert out.returncode == 0, out.stderr
    n, dealt, known = out.stdout.split()
    assert int(n) > 100 and dealt == "0" and known == "True"


def test_a_fault_in_them_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidemark" / "llm").mkdir()
    (tmp_path / "tidemark" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidemark" / "llm" / "queries.py").write_text("import a_module_that_is_missing\n")
    out = run(tmp_path, COUNT)
    assert out.returncode != 0 and "a_module_that_is_missing" in out.stderr
