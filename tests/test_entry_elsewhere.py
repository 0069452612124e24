"""The driver loads __spark_entry__ from its own working directory, where
Python workers cannot import this package: the Arrow-batch functions must
travel with their tasks."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4") \\
    .config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
n = m.entry(spark).count()
g = m.queries()["sequence_gaps"](spark, "/root/testdata/sf0.001").count()
print("RESULT", n, g)
"""


def test_entry_runs_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    line = [l for l in out.stdout.splitlines() if l.startswith("RESULT")]
    assert line, out.stderr[-3000:]
    _, n, g = line[0].split()
    assert int(n) > 0 and int(g) > 0
