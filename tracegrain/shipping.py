"""Make this package importable where Spark runs Python, whatever the working folder there is."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tracegrain-"), "tracegrain.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        archive.write(whole, os.path.join("tracegrain", os.path.relpath(whole, root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
