"""Make the package importable on workers."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers of this application, once, unless they start where it
    lies: in the driver's folder or on the path that they inherit."""
    root = Path(__file__).resolve().parent.parent.parent
    inherited = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in inherited or Path.cwd().resolve() == root or spark.sparkContext.applicationId in _SHIPPED:
        return
    name = Path(tempfile.mkdtemp(prefix="haulgrid-")) / "haulgrid.zip"
    with zipfile.ZipFile(name, "w") as out:
        for file in [*(root / "haulgrid").rglob("*.py"), *root.glob("corpus_pipeline.py")]:
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(name))
    sys.path[:] = [p for p in sys.path if p != str(name)]  # the driver has the sources
    _SHIPPED.add(spark.sparkContext.applicationId)
