"""The registry with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_stands_alone(tmp_path):
    """Without the subpackage, whether or not the pipeline's file is there, the other queries are listed."""
    shutil.copytree(ROOT / "marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); assert not set(e.oracle_sql()) - set(e.queries())"]
    listed = []
    for names in (("__spark_entry__.py",), ("__spark_entry__.py", "corpus_pipeline.py")):
        for name in names:
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, tmp_path / name)
        listed.append(subprocess.run(ask, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split())
    assert listed[0] == listed[1] and "kb_text_search" in listed[0] and not any(q == "pipeline" or q.startswith("op") for q in listed[0])
