"""Giving the executors' Python this package, and rows to all tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of rows that go to Python at once. Spark's own limit of 64 MB is held several times over by the JVM and by Python, for each
#: core; a session that sets another limit keeps it.
BATCH_BYTES = 4 << 20
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shipped(spark: SparkSession | None = None) -> None:
    """Once for each application; nothing needs to be installed on the executors."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if getattr(shipped, "app", None) == app:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vertexloom-py-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
    shipped.app = app


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over tasks, for work that costs far more than moving its rows: a file of one row group is read by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def python_rows(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """mapInArrow with the package at hand, in batches of BATCH_BYTES about (a longer row comes alone)."""
    shipped(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _SPARKS_OWN) == _SPARKS_OWN:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(function, schema)
