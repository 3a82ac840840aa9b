"""The entry module in a process of its own, without a Spark session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_and_lists_queries_without_spark():
    code = "import __spark_entry__ as e, pyspark; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 150; assert pyspark.SparkContext._active_spark_context is None"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
