"""The entry module loads, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), len([n for n in q if n == 'pipeline' or n.startswith('op')]))"


@pytest.mark.parametrize("without", [["tapeloom/llm", "corpus_pipeline.py"], ["tapeloom/llm"], ["corpus_pipeline.py"]], ids=" ".join)
def test_loads_without(tmp_path, without):
    skipped = {os.path.join(ROOT, w) for w in [*without, ".git", "tests"]}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [n for n in names if os.path.join(d, n) in skipped or n == "__pycache__"])
    out = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    every, optional = map(int, out.stdout.split())
    assert every - optional > 280
    assert (optional == 0) == ("tapeloom/llm" in without)
