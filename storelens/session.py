"""Sessions, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that the operators count on; sizes of partitions are the cluster's affair.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = "*", memory: str = "8g", **more: str) -> SparkSession:
    """A session on this machine, for tests and small repositories."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shipped(spark: SparkSession) -> SparkSession:
    """``spark``, with this package importable in its Python workers, wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_storelens_shipped", False):
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="storelens-")) / "storelens.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
        context._storelens_shipped = True
    return spark
