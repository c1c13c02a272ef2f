"""Making this package importable in Python workers that were not started from its folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def _found_by_workers() -> bool:
    """Whether workers that this machine starts find the package by its folder."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and Path(p).resolve() == ROOT for p in places)


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors once a context, unless workers find them anyway."""
    sc = spark.sparkContext
    if _found_by_workers() or getattr(sc, "_tidemark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark-src.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((ROOT / "tidemark").rglob("*.py")):
            out.write(path, path.relative_to(ROOT))
    sc.addPyFile(str(archive))
    sc._tidemark_shipped = True
