"""Functions that run in Python workers work away from the repository folder."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config(
    "spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.addPyFile(sys.argv[1])
from cohortloom.catalog import QUERIES
for name in ("k10_bootstrap_intervals", "k12_convergence_grid"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_zip_on_an_empty_folder(tmp_path):
    package = tmp_path / "src"
    shutil.copytree(f"{ROOT}/cohortloom", package / "cohortloom", ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(str(tmp_path / "cohortloom"), "zip", package)
    work = tmp_path / "work"
    work.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM, archive], cwd=work, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
