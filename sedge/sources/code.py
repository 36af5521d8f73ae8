"""The code of this package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it."""
    if getattr(spark, "_sedge_shipped", None) == spark.sparkContext.applicationId:
        return
    top = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="sedge-code-")) / "sedge_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((top / "sedge").rglob("*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(str(target))
    spark._sedge_shipped = spark.sparkContext.applicationId
