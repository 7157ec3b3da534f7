"""The driver contract without the optional folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r}:
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "review_listing" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_imports_without_the_optional_parts():
    for gone in ("spanledger.llm", "corpus_pipeline", "public_tokenizers", "xxhash"):
        done = subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], cwd=ROOT, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
