"""Makes the package importable once per application."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """A zip for the executors, and the source folder on the Python path for workers that Spark starts beside the
    driver (stateful streaming asks one for the state schema)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        sc.environment["PYTHONPATH"] = os.pathsep.join(
            dict.fromkeys([ROOT, *sc.environment.get("PYTHONPATH", "").split(os.pathsep)])).rstrip(os.pathsep)
        base = os.path.join(tempfile.mkdtemp(prefix="wirefold-ship-"), "wirefold")
        sc.addPyFile(shutil.make_archive(base, "zip", ROOT, "wirefold"))
        _shipped.add(sc.applicationId)
