"""Executors import the package whatever folder the driver was started from."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["gram_vector_product"](spark, "/root/testdata/sf0.001").count())
"""


def test_query_from_another_folder_without_pythonpath(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script), ROOT], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=240)
    assert "rows 64" in out.stdout, out.stderr[-2000:]
