"""Cells, observations, points and distances from the star-schema tables: the inputs of the spatial queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, lattice


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(name: str) -> F.Column:
    return F.col(name).cast("long")


def _snapped(df: DataFrame, x, y, z, *others) -> DataFrame:
    df = df.select(x.alias("x"), y.alias("y"), z.alias("z"), *others)
    sx, sy, sz = lattice.snap(F.col("x"), F.col("y"), F.col("z"))
    return df.select(sx.alias("x"), sy.alias("y"), sz.alias("z"), *df.columns[3:])


def cells(spark: SparkSession, sf_dir: str, n: int = 32) -> DataFrame:
    """x, y, z (0 to n - 1), value; many rows a cell."""
    x, y, z = _long("l_partkey") % n, _long("l_suppkey") % n, (_long("l_orderkey") + _long("l_linenumber")) % n
    return _snapped(read(spark, sf_dir, "lineitem"), x, y, z, F.col("l_extendedprice").alias("value"))


def cell_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells with their Index64 at level 5."""
    five, zero = F.lit(5), F.lit(0)
    return cells(spark, sf_dir).select(ids.index64(zero, zero, five, F.col("x"), F.col("y"), F.col("z")).alias("cell"), "x", "y", "z", "value")


def signed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _long("c_custkey")
    return _snapped(read(spark, sf_dir, "customer"), c % 200 - 100, (c * 7) % 200 - 100, (c * 13) % 200 - 100, c.alias("id"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [(F.col("embedding")[i].cast("double") * 10).alias(n) for i, n in enumerate("xyz")]
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *v)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z (0 to 15), ts, seq, occupied, confidence; (ts, seq) is a total order."""
    e = _long("event_id")
    others = [
        F.col("ts"), e.alias("seq"), F.col("event_type").isin("error", "purchase").alias("occupied"),
        (0.55 + 0.4 * (F.col("value") % 100) / 100).alias("confidence"),
    ]
    return _snapped(read(spark, sf_dir, "events"), _long("user_id") % 16, e % 16, F.floor(e / 16).cast("long") % 16, *others)


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, sdf, weight and an order."""
    x, y, z = _long("l_partkey") % 32, _long("l_suppkey") % 32, (_long("l_orderkey") + _long("l_linenumber")) % 32
    order = (_long("l_orderkey") * 8 + _long("l_linenumber")).alias("seq")
    return _snapped(read(spark, sf_dir, "lineitem"), x, y, z, ((F.col("l_discount") - 0.05) * 2).alias("sdf"), F.lit(1.0).alias("weight"), order)
