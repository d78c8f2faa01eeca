import os
import subprocess
import sys

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["frame", "mass", "y", "x"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_session_made_before_the_entry_module(tmp_path):
    """Its workers get the package with the first query."""
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "file://{tmp_path}/w").getOrCreate()
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
import __spark_entry__
print("rows", __spark_entry__.queries()["bandpass"](spark, {__spark_entry__.SMALL!r}).count(), __spark_entry__.entry(spark).count())
"""
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=own, capture_output=True, text=True, timeout=180)
    assert "rows" in done.stdout, done.stderr[-2000:]
