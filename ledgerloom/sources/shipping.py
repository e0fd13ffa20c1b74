"""Making this package importable on executors that do not have it."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """A folder for the archive: below the session's shared checkpoint folder if that is a mounted path, else the driver's own."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    if shared.startswith(("file:", "/")):
        path = os.path.join(re.sub("^file:/*", "/", shared), f"package-{spark.sparkContext.applicationId}")
        os.makedirs(path, exist_ok=True)
        return path
    return tempfile.mkdtemp(prefix="ledgerloom-")


def ship(spark: SparkSession) -> None:
    """Send the package to the session's executors, once; Spark serves the file from the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(_folder(spark), "ledgerloom_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
