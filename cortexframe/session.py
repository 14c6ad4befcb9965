"""Session helper for tests, the benchmark and notebooks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, whatever the working folder.

    A local session gets the folder, executors on other machines get a small zip file from the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if sc.master == "local" or sc.master.startswith("local["):
        sc.addFile(str(package), recursive=True)
    else:
        target = Path(tempfile.mkdtemp(prefix="cortexframe-")) / "cortexframe.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cortexframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark
