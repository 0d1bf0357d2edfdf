"""Settings: what is set elsewhere wins."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from cilode.session import session
spark = session("x", spark__master="local[1]", spark__sql__shuffle__partitions="3")
for key in ("files.maxPartitionBytes", "session.timeZone", "files.openCostInBytes", "shuffle.partitions"):
    print("=", spark.conf.get("spark.sql." + key))
spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
print("=", session("y").conf.get("spark.sql.session.timeZone"))
"""


def run(**submitted):
    held = " ".join(f"--conf spark.sql.{k.replace('__', '.')}={v}" for k, v in submitted.items())
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": f"--conf spark.ui.enabled=false {held} pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, check=True).stdout
    return [line[2:] for line in out.splitlines() if line.startswith("= ")]


def test_submitted_values_win():
    got = run(files__maxPartitionBytes="256m", session__timeZone="Europe/Oslo")
    assert got == ["256m", "Europe/Oslo", "128k", "3", "Asia/Tokyo"]


def test_no_split_size_is_forced():
    size, zone, *_ = run()
    assert size in ("128MB", "134217728", "134217728b") and zone == "UTC"
