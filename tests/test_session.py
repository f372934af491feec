import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as se
from seriesmith.session import build_session
spark = build_session(2, 2, "elsewhere")
spark.sparkContext.setLogLevel("ERROR")
print("rows", se.queries()["frequency_features"](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_another_folder(tmp_path):
    """Workers started elsewhere get the package from the driver."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=280)
    assert "rows" in done.stdout, done.stderr[-2000:]
