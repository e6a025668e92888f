"""Operators on workers that have only what Spark sends them."""

import os
import pathlib
import subprocess
import sys

REPO = pathlib.Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
import corpus_pipeline
from flowspark import build_session
from flowspark.llm import QUERIES
spark = build_session("clean", master="local[2]", **{{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {shared!r}}})
sys.path.pop(0)
for name in ("op4_language_id", "op11_periodic_runs", "op12_lm_scoring", "op13_hard_negatives"):
    print(name, QUERIES[name](spark, {tables!r}).count())
docs = spark.read.parquet({tables!r} + "/documents.parquet")
print("pipeline", corpus_pipeline.identify_language(spark, docs, {tables!r}).count())
"""


def test_workers_need_not_have_the_package(tables, tmp_path):
    (tmp_path / "empty").mkdir()
    script = SCRIPT.format(repo=str(REPO), tables=tables, shared=f"file://{tmp_path}/shared")
    env = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "empty", env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines())
    assert set(counts) == {"op4_language_id", "op11_periodic_runs", "op12_lm_scoring", "op13_hard_negatives", "pipeline"}
    assert all(int(n) > 0 for name, n in counts.items() if name != "op13_hard_negatives")
