"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

Sources share a budget of words by weight. A source whose share is above ``max_epochs`` times its size is
clamped there and the excess goes to the others by weight, until no share is above its cap. A source then
takes every document a whole number of times and, for the fraction that is left, the documents whose seeded
hash is below a threshold. The threshold comes from word counts by hash bucket and then from the hashes of one
bucket of about the square root of the source's rows, so that no task sees a whole source. Rows equal in id and text share
a hash; where the threshold falls on such rows, they are numbered and as many as come nearest to the target are taken.

Null text has size 0. A null source is a source and sorts last. Null ids and repeated rows are rows like any
other. An empty table gives an empty result. Columns of the input that are named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, hash63, own_names, small, stored, table

HASH_BITS = 60


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, order: list) -> DataFrame:
    """Adds rank from 0 by a global sort: ranges of partitions and the counts of those before."""
    ids = stored(sources.orderBy(*order).withColumn("id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("id", 33)
    counts = ids.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    on = part == F.col("part")
    return ids.join(F.broadcast(offsets), on).withColumn("rank", F.col("offset") + F.expr("id & 8589934591")).drop("id", "part", "offset")


def mixing_plan(narrow: DataFrame, weights: tuple[float, ...], max_epochs: int, budget: int | None) -> tuple[DataFrame, int]:
    """narrow: source, size, h. One row per source: source, source_size, target, whole, h_star (the last hash that
    the fractional repetition takes, -1 for none), tied (rows with that hash), tied_taken; and how many sources there are."""
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sources = ranked(sources, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs), "mix-weights")
    n_sources, total, all_caps, all_weights = sources.agg(F.count("*"), F.sum("source_size"), F.sum("cap"), F.sum("weight")).first()
    free_words, free_weight = float(total or 0) if budget is None else float(budget), float(all_weights or 0)
    words_left = free_words
    clamped = 0
    while free_weight > 0:  # each round clamps at least one more source; only sums come to the driver
        above = F.col("cap") < F.lit(free_words) * F.col("weight") / F.lit(free_weight)
        n, caps, weight_left = sources.agg(
            F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0))
        ).first()
        if n == clamped:
            break
        clamped, free_words, free_weight = n, words_left - float(caps), float(weight_left)
    share = F.lit(free_words) * F.col("weight") / F.lit(free_weight or 1.0)
    target = F.least(share, F.col("cap").cast("double")) if free_weight else F.col("cap").cast("double")
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.select(
        "source", "source_size", target.alias("target"), whole.alias("whole"),
        F.ceil(F.log2(F.col("n_rows").cast("double")) / 2).cast("int").alias("bits"),
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stored(plan, "mix-plan")

    side = small(plan.select(F.col("source").alias("s"), "rest", "bits"), n_sources)
    part = narrow.join(side, F.col("source").eqNullSafe(F.col("s"))).filter("rest > 0")
    part = part.withColumn("bucket", F.expr(f"shiftright(h, {HASH_BITS} - bits)"))
    sums = part.groupBy("s", "bucket", "rest", "bits").agg(F.sum("size").alias("in_bucket"))
    upto = Window.partitionBy("s").orderBy("bucket")
    edge = sums.withColumn("upto", F.sum("in_bucket").over(upto)).filter("upto > rest and upto - in_bucket <= rest")
    edge = stored(edge.select("s", "bucket", "rest", "bits", (F.col("upto") - F.col("in_bucket")).alias("before")), "mix-edge")
    rows = narrow.join(
        small(edge.select(F.col("s").alias("e"), F.col("bucket").alias("b"), "rest", "bits", "before"), n_sources),
        F.col("source").eqNullSafe(F.col("e")) & (F.expr(f"shiftright(h, {HASH_BITS} - bits)") == F.col("b")),
    )
    hashes = rows.groupBy("e", "h", "before", "rest").agg(F.sum("size").alias("of_hash"), F.count("*").alias("tied"))
    upto = F.col("before") + F.sum("of_hash").over(Window.partitionBy("e").orderBy("h"))
    hashes = hashes.withColumn("upto", upto).filter("upto > rest and upto - of_hash <= rest")
    # Of the rows with the hash on which the rest ends, as many as come nearest to it.
    near = F.floor((F.col("rest") - F.col("upto") + F.col("of_hash")) / (F.col("of_hash") / F.col("tied")) + 0.5)
    stars = hashes.select("e", F.col("h").alias("h_star"), near.alias("tied_taken"), "tied")
    out = plan.join(stars, F.col("source").eqNullSafe(F.col("e")), "left")
    none = lambda c, x: F.coalesce(c, F.lit(x)).cast("long").alias(c)
    return stored(out.select("source", "source_size", "target", "whole", none("h_star", -1), none("tied_taken", 0), none("tied", 0)), "mix-final"), n_sources


def numbered_ties(tied: DataFrame) -> DataFrame:
    """Rows (with __s and __h) with __number, from 0 in each __s: numbers within partitions and the counts of those before."""
    tied = stored(tied.withColumn("__at", F.monotonically_increasing_id()), "mix-ties").withColumn("__part", F.shiftright("__at", 33))
    counts = tied.groupBy("__s", "__part").count()
    before = Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__s").alias("__c"), F.col("__part").alias("__p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    number = F.row_number().over(Window.partitionBy("__s", "__part").orderBy("__at")) - 1
    tied = tied.withColumn("__n", number).join(counts, F.col("__s").eqNullSafe(F.col("__c")) & (F.col("__part") == F.col("__p")))
    return tied.withColumn("__number", F.col("__n") + F.col("__first")).drop("__at", "__part", "__n", "__c", "__p", "__first")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, budget: int | None = None, seed: int = 17, thin: bool = False
) -> DataFrame:
    """docs (doc_id, text, source, ...) with __size, __source_size, __target, __repeats and __taken; thin: without the texts.

    weights go to the sources in the order of their names, again and again. budget: words to take in all, by
    default as many as there are. No row is dropped; repeats may be 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h = hash63(F.lit(f"mix{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    added = ("size", "h", "source", "source_size", "target", "whole", "h_star", "tied", "tied_taken", "number", "repeats", "taken", "s", "at", "part", "n", "c", "p", "first")
    docs = docs.drop(*[f"__{c}" for c in added]).select("*", words(F.col("text")).alias("__size"), h.alias("__h"))
    narrow = stored(docs.select("doc_id", "source", "__size", "__h"), "mix-rows")
    plan, n = mixing_plan(narrow.select("source", F.col("__size").alias("size"), F.col("__h").alias("h")), weights, max_epochs, budget)
    ties = plan.filter("tied_taken > 0 and tied_taken < tied").count()
    plan = small(plan.select([F.col(c).alias(f"__{c}") for c in plan.columns]), n)
    out = (narrow if thin else docs).join(plan, F.col("source").eqNullSafe(F.col("__source")))
    part = (F.col("__h") == F.col("__h_star")) & (F.col("__tied_taken") < F.col("__tied"))
    if ties:
        split = numbered_ties(out.filter(part & (F.col("__tied_taken") > 0)).withColumn("__s", F.col("source"))).drop("__s")
        out = out.filter(~(part & (F.col("__tied_taken") > 0))).withColumn("__number", F.lit(0).cast("long")).unionByName(split)
    else:
        out = out.withColumn("__number", F.lit(0).cast("long"))
    takes = (F.col("__h") < F.col("__h_star")) | ((F.col("__h") == F.col("__h_star")) & (F.col("__number") < F.col("__tied_taken")))
    out = out.withColumn("__repeats", F.col("__whole") + takes.cast("long"))
    return out.withColumn("__taken", F.col("__size") * F.col("__repeats")).drop("__source", "__whole", "__h_star", "__h", "__tied", "__tied_taken", "__number")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(own_names(table(spark, sf_dir, "documents"), ["doc_id", "text", "source"]), thin=True)
    return mixed.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken", "repeats")])


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS row_number_, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (3 * source_size)::DOUBLE AS cap,
             ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
o AS (SELECT *, (SELECT sum(source_size)::DOUBLE FROM s) AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM w),
c AS (SELECT *, cap < (total - caps) * weight / left_weight AS clamped FROM o),
f AS (SELECT max(total) - coalesce(sum(cap) FILTER (clamped), 0) AS free_words, sum(weight) FILTER (NOT clamped) AS free_weight FROM c),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE least(free_words * weight / free_weight, cap) END AS target FROM c, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT d.doc_id, d.size, d.h, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, row_number_ ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END)::BIGINT AS repeats
FROM r
"""
