"""Session helpers: shipping this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once for each application.

    Workers of a cluster don't share the driver's sys.path; Spark serves the
    archive to every executor, also to those that join later.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="siftwood-"), "siftwood.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, Path(root.name) / path.relative_to(root))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark
