import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert len(q) > 40 and len(s) > 40 and set(s) <= set(q), (len(q), len(s))
assert not [k for k in q if k.startswith("op") or k == "pipeline"], sorted(q)
import bench
"""


@pytest.mark.parametrize("without", [["linkblocks/llm"], ["linkblocks/llm", "corpus_pipeline.py"]])
def test_core_stands_without_the_optional_subpackage(tmp_path, without):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    for name in without:
        if (to / name).is_file():
            (to / name).unlink()
    done = subprocess.run([sys.executable, "-c", CODE], cwd=to, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
