"""The driver's entry with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
SCRIPT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, sum(n.startswith('op') for n in q))"


def run(folder) -> list[str]:
    return subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, capture_output=True, text=True, check=True, timeout=120).stdout.split()


def copy_without(tmp_path, *gone):
    def ignored(folder, names):
        here = Path(folder).relative_to(ROOT)
        return [n for n in names if str(here / n) in gone or n in (".git", "__pycache__")]

    return shutil.copytree(ROOT, tmp_path / "tree", ignore=ignored)


def test_entry_without_llm_folders(tmp_path):
    """With both folders deleted the core queries stay, whether or not the pipeline's file is there."""
    from pagelattice.plans import registry

    for gone in ((), ("corpus_pipeline.py",)):
        tree = copy_without(tmp_path / str(len(gone)), "pagelattice/llm", "tests/llm", *gone)
        assert run(tree) == [str(len(registry.QUERIES)), "False", "0"]
