"""Knowledge graphs from declarative mappings, on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Send this package to the Python workers of a session's executors, once; they may have no copy of it."""
    context = spark.sparkContext
    if getattr(context, "_kgspark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="kgspark-"), "kgspark.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("kgspark", os.path.relpath(path, here)))
    context.addPyFile(to)
    context._kgspark_shipped = True
