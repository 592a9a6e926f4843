"""The library without the llm folders: they are deleted on a copy, then the rest is imported and collected."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CHECK = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n == 'pipeline' or n[:2] == 'op' and n[2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_core_without_llm(tmp_path, pipeline_too):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("kindred/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    for command in (["-c", CHECK], ["-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"]):
        got = subprocess.run([sys.executable, *command], cwd=copy, capture_output=True, text=True, timeout=300)
        assert got.returncode == 0, got.stdout + got.stderr


def test_nothing_imports_llm():
    for path in (ROOT / "kindred").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "kindred").parts:
            assert "kindred.llm" not in path.read_text(), path
