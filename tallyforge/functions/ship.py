"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once a context, unless their PYTHONPATH has it."""
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_tallyforge_shipped", False):
        return
    name = os.path.join(tempfile.mkdtemp(), f"{_ROOT.name}.zip")
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(_ROOT.rglob("*.py")):
            out.write(path, path.relative_to(_ROOT.parent))
    context.addPyFile(name)
    context._tallyforge_shipped = True
