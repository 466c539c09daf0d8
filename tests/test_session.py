"""The package reaches workers that can't import it."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver's only
from pyspark.sql import functions as F
from glossa.functions.comments import decode_entities
from glossa.session import reach, session
spark = session("local-cluster[1,1,1024]", **{"spark.ui.enabled": "false"})
reach(spark)
print("found", [r.x for r in spark.createDataFrame([("a &amp; b",)], "s string").select(decode_entities("s").alias("x")).collect()])
"""


def test_shipped_package(tmp_path):
    (tmp_path / "p.py").write_text(PROGRAM)
    out = subprocess.run([sys.executable, str(tmp_path / "p.py"), str(Path(__file__).resolve().parents[1])], capture_output=True, text=True, cwd=tmp_path, timeout=240, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable})
    assert "found ['a & b']" in out.stdout, out.stderr[-2000:]
