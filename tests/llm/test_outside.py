"""Python workers need not have the package: the operators run from a folder outside the repository."""

import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])
NAMES = ["op6_lm_score", "op9_html_text", "op10_decontaminate", "op11_vector_codes", "op12_embedding_dedup",
         "op13_centroid_clusters", "pipeline"]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as contract
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())

def lost(_):
    try:
        import surveyspark
    except ModuleNotFoundError:
        return 1
    return 0

assert all(spark.sparkContext.parallelize(range(8), 4).map(lost).collect()), "workers have the package"
queries = contract.queries()
for name in {names!r}:
    print("done", name, queries[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_workers_without_the_package(tmp_path):
    script = SCRIPT.format(repo=REPO, folder=str(tmp_path / "stages"), names=NAMES)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("done ") == len(NAMES)
