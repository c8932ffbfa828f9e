"""Operator folders may be absent; one that is there has to import."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_absent_modules_are_told_from_broken_ones(tmp_path):
    assert entry._there("plumbline.plans.catalog")
    assert not entry._there("plumbline.nothing") and not entry._there("nothing.at.all")
    (tmp_path / "corpus_pipeline.py").write_text("import nothing_like_it\n")
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    if entry.llm is None:
        return
    path = {"PYTHONPATH": f"{tmp_path}:{ROOT}", "PATH": "/usr/bin:/bin"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=path, capture_output=True, text=True, timeout=100)
    assert said.returncode and "nothing_like_it" in said.stderr
