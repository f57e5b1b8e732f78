"""Where intermediate tables go."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from ledgermatch.sources.rounds import RunFolder, shared_folder
first = shared_folder(spark)
folder = RunFolder(spark)
assert folder.table(spark.range(3), "t").count() == 3 and folder.path.startswith(first + "/run-")
assert shared_folder(spark) == first
folder.remove()
"""


def test_a_local_session_without_a_shared_folder_gets_one():
    home = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=home, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
