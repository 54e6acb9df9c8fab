"""A corpus from documents: toxic documents and copies go, benchmark passages go, sources are mixed, shards are dealt.

Each stage takes all that the one before kept. All columns of documents, whatever their names, are kept up to the last stage,
which adds shard and slot (a column of that name in documents is replaced there).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import common, mixing, sharding, toxicity, triejoin, winnow


def _with_others(docs: DataFrame, names: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What step leaves of docs, whose columns it sees by these names; all others go through it as one."""
    return common.together(step(common.apart(docs, names)), names, docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, toxicity.training_labels(common.table(spark, sf_dir, "labels")))
    return _with_others(docs, ["text"], lambda d: toxicity.score_toxicity(d, model).filter(F.col("__score") < toxicity.THRESHOLD))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_others(docs, ["doc_id", "text"], lambda d: triejoin.one_of_each(d, n=5, percent=80))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = common.table(spark, sf_dir, "benchmark")
    return _with_others(docs, ["text"], lambda d: winnow.find_benchmark(d, benchmark).filter(F.size("__hits") == 0))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it."""

    def step(d: DataFrame) -> DataFrame:
        mixed = mixing.mix_sources(d).filter("__repeats > 0")
        return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__repeats").cast("int"))))

    return _with_others(docs, ["doc_id", "text", "source"], step)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    dealt = sharding.shard_records(common.apart(docs.select(*[F.col(f"`{c}`") for c in names]), ["doc_id", "text"]), [1.0] * 8)
    dealt = dealt.select("doc_id", "text", "others", "__shard", "__slot")
    kept = [F.col(c) if c in ("doc_id", "text") else F.col(f"others.`{c}`").alias(c) for c in names]
    return dealt.select(*kept, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]
#: Hashing and iteration have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
