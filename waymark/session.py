"""The package on the workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once; not needed where it is installed on them."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package, folder = Path(__file__).resolve().parent, Path(tempfile.mkdtemp(prefix="waymark-ship-"))
    # The driver serves the archive from here as long as it lives.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, folder / "tree" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "tree", package.name))
    _SHIPPED.add(sc.applicationId)
