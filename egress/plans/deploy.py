"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session unless workers find it already (installed, on PYTHONPATH, or in the working folder of a local master)."""
    context = spark.sparkContext
    on_path = str(ROOT) in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    if on_path or (context.master.startswith("local") and Path.cwd() == ROOT) or getattr(context, "_egress_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="egress-zip-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "egress"), "zip", ROOT, "egress"))
    context._egress_shipped = True
