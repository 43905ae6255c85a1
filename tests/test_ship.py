"""Python operators work when only the driver can import the package."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in ("c9_stem_vocabulary", "c10_preprocess", "d6_embed_distinct_tags", "j8_batch_score"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("shipped")
"""


def test_session_started_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, ROOT], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert "shipped" in run.stdout, run.stderr[-2000:]
