"""The driver's contract, with and without the llm operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(code: str) -> set[str]:
    out = subprocess.run([sys.executable, "-c", code + "\nimport __spark_entry__ as e\nassert set(e.oracle_sql()) <= set(e.queries())\nprint(*e.queries())"], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def test_queries_with_and_without_llm():
    without = names("import sys\nsys.modules['corpus_pipeline'] = None")
    assert "polyline_length" in without and not any(n.startswith("op1") or n == "pipeline" for n in without)
    assert without <= names("")
