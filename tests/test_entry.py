import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_and_names(spark):
    assert entry.entry(spark).count() == 177
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 45


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest imports where their folder is gone, where an empty one is left, and not where a module fails."""
    for case in ("gone", "empty", "broken"):
        root = tmp_path / case
        shutil.copytree(ROOT / "snapweave", root / "snapweave", ignore=shutil.ignore_patterns("__pycache__", "llm"))
        shutil.copy(ROOT / "__spark_entry__.py", root)
        if case != "gone":
            (root / "snapweave" / "llm").mkdir()
            (root / "corpus_pipeline.py").write_text("from snapweave.llm import queries\nORACLE_SQL = run = None\n")
        if case == "broken":
            (root / "snapweave" / "llm" / "queries.py").write_text("import no_such_module\n")
        code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"
        done = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)
        assert (done.returncode == 0) == (case != "broken"), (case, done.stderr)
        assert case == "broken" or done.stdout.split()[1] == "False"
