"""The entry module must import without a session, also from a zipped PySpark."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

REPO = Path(__file__).resolve().parents[1]


def test_import_needs_no_session():
    lib = Path(pyspark.__path__[0]) / "python" / "lib"
    zips = [str(lib / "pyspark.zip"), *map(str, lib.glob("py4j-*.zip"))]
    code = (
        "import __spark_entry__ as e, pyspark;"
        "from pyspark import SparkContext;"
        "assert len(e.queries()) >= 50 and len(e.oracle_sql()) >= 50;"
        "assert SparkContext._active_spark_context is None"
    )
    run = subprocess.run(
        [sys.executable, "-c", code],
        cwd=REPO,
        env=os.environ | {"PYTHONPATH": os.pathsep.join([str(REPO), *zips])},
        capture_output=True,
        text=True,
    )
    assert run.returncode == 0, run.stderr
