"""The library and its queries work where the training-data subpackage and its tests have been deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as entry
names = set(entry.queries())
assert names and not any(n.startswith("op") for n in names) and "pipeline" not in names, names
assert set(entry.oracle_sql()) <= names
assert entry.__file__.startswith({folder!r}), entry.__file__
print(len(names))
"""


def test_queries_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", "corpus_pipeline.py"))
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(folder=str(copy))], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_queries_with_only_the_folders_deleted(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(folder=str(copy))], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "tideline").rglob("*.py"), *(ROOT / "tests").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != Path(__file__).name:
            assert "tideline.llm" not in path.read_text(), path
