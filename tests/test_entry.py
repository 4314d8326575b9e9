"""The entry module imports with and without the parts that may be absent."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("staylens/llm", "tests/llm"), ("staylens/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n.startswith((".git", "__pycache__", ".pytest"))
                                                              or os.path.relpath(os.path.join(folder, n), ROOT) in gone])
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
                           "print(len(q), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), set(o) <= set(q))"],
                          cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, extra, same = said.stdout.split()
    assert int(n) > 290 and extra == "False" and same == "True"
