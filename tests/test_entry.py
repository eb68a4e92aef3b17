"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in q))"


def names(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_queries_without_the_subpackage(tmp_path):
    here = tmp_path / "copy"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(here / "framelake" / "llm", ignore_errors=True)
    n, some = names(here)  # the pipeline's file may still be there
    assert some == "False" and int(n) > 140
    (here / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(here) == [n, "False"]
