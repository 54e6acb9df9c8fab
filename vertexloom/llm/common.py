"""Shared folders, size-checked joins and table access for the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import BATCH_BYTES, python_rows, shipped  # noqa: F401  for the operators

#: Words as the contracts count them: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a broadcast side may have at most; beyond it joins shuffle. Rows here are narrow (about 100 bytes).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is named and all work runs in this process, as in tests."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not named:
        if not conf.get("spark.master", "").split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(_folder, "own", None)
        if named is None:
            named = _folder.own = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
            atexit.register(shutil.rmtree, named[7:], True)
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; else as it is, to be shuffled."""
    return F.broadcast(df) if rows <= limit else df


def hash63(*parts) -> "F.Column":
    """The first 60 bits of an MD5 as a long from 0 on: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def text_last(df: DataFrame) -> DataFrame:
    """df with its column text as the last one."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != "text"], "text")


def more_columns(df: DataFrame, more: str) -> StructType:
    """df's schema with more columns; names may be any, nested ones too."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def apart(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, and all others as one column, so that no name which an operator adds can meet one of theirs."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*[F.col(f"`{n}`") for n in names], (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("others"))


def together(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """Undoes apart(): the columns as they were."""
    return df.select(*[F.col(f"`{c}`") if c in names else F.col(f"others.`{c}`").alias(c) for c in columns])


def own_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns; extra columns, whatever their names, are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])
