"""Workers need no copy of the package; staged tables go to the folder that the session names."""

import os
import subprocess
import sys

from ledgerlake.staging import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
from ledgerlake.session import local_session
from ledgerlake.operators.isolation import isolation_scores
from ledgerlake.staging import shared_dir
spark = local_session(2, 2)
assert shared_dir(spark) == sys.argv[1]
rows = spark.range(300).selectExpr("id AS k", "double(id % 17) AS x")
print("SCORED", isolation_scores(rows, "k", ["x"], 300, trees=5).filter("score < 0").count())
"""


def test_jobs_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYSPARK_SUBMIT_ARGS"] = f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"
    done = subprocess.run([sys.executable, "-c", JOB, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "SCORED 300" in done.stdout, done.stderr[-2000:]


def test_local_sessions_have_a_folder(spark):
    assert os.path.isdir(shared_dir(spark))
