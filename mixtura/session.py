"""Session set-up: builder for local use, and shipping of this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName("mixtura")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package and the modules beside it, once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_mixtura_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="spark-")) / "mixtura_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in [*sorted((ROOT / "mixtura").rglob("*.py")), *sorted(ROOT.glob("*.py"))]:
                z.write(path, path.relative_to(ROOT))
        context.addPyFile(str(target))
        context._mixtura_shipped = True
    return spark
