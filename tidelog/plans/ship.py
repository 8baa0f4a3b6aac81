"""The package's own code for workers that can't import it from where the driver has it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each context; new executors get them too."""
    sc = spark.sparkContext
    if getattr(sc, "_tidelog_shipped", False):
        return
    with tempfile.NamedTemporaryFile(prefix="tidelog-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(ROOT.glob("tidelog/**/*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(f.name)
    sc._tidelog_shipped = True
