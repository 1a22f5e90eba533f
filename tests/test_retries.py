"""Task retries give identical results: kernels are deterministic and
write nothing outside their output (run in a separate JVM, local[4,3])."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = os.path.join(ROOT, "tests", "scripts", "retry_run.py")


def _run(mode):
    out = subprocess.run([sys.executable, SCRIPT, ROOT, mode], capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    return json.loads(out.stdout.strip().splitlines()[-1])


def test_retried_tasks_give_identical_results():
    clean, flaky = _run("clean"), _run("flaky")
    assert clean == flaky
