"""The entry point without the operators for training data, or without a library that only they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise {error}(name)
sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
names = set(entry.queries())
assert "snapshot_validity" in names and set(entry.oracle_sql()) <= names
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
"""


@pytest.mark.parametrize(
    "name,error",
    [("tidegraph.llm", "ModuleNotFoundError"), ("corpus_pipeline", "ModuleNotFoundError"), ("tiktoken", "ModuleNotFoundError"),
     ("sentencepiece", "ImportError")],
)
def test_the_other_queries_stay(name, error):
    code = HIDE.format(name=name, error=error, root=ROOT)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
