"""Executors need no copy of the package: a driver that has it on its own path only runs every operator."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys

sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession

from lodestone.llm import bpe, pieces, queries

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
bpe.load(queries.bpe_path())  # what the driver has loaded is not sent along
pieces.load(queries.pieces_path())
for name, query in queries.QUERIES.items():
    print(name, query(spark, "/root/testdata/sf0.001").count() > 0, flush=True)
"""


def test_operators_run_where_executors_have_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(SCRIPT)
    done = subprocess.run([sys.executable, "run.py", ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [x.split()[1] for x in done.stdout.splitlines() if x.startswith("op")] == ["True"] * 13
