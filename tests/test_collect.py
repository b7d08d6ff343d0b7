"""All tests are collected in one run."""

import subprocess
import sys
from pathlib import Path

TESTS = Path(__file__).resolve().parent


def test_files_named_alike_are_collected():
    command = [sys.executable, "-m", "pytest", str(TESTS), "--collect-only", "-q", "-p", "no:cacheprovider"]
    done = subprocess.run(command, cwd=TESTS.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stdout
    found = {line.partition("::")[0] for line in done.stdout.splitlines() if "::" in line}
    assert found == {str(p.relative_to(TESTS.parent)) for p in TESTS.rglob("test_*.py")}
