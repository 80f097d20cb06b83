"""Queries must run from a plain session in a process started outside the repository folder:
Python workers then cannot import this package, so nothing shipped to them may need it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as E
q = E.queries()
n = q["auto_topic_clusters"](spark, "/root/testdata/sf0.001").count()
m = q["report_grouped_entities_topic"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n, m)
"""


def test_python_worker_code_needs_no_package(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("ROWS")]
    assert line, out.stderr[-2000:]
    n, m = map(int, line[0].split()[1:])
    assert n > 0 and m == n
