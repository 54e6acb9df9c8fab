"""Value layers keyed by cell: aggregation, roll-up, occupancy and distance fusion, and what is derived from them.

Fusion clamps after every step, so order counts. An update x -> clamp(x + d, lo, hi) composes with others into
x -> clamp(x + A, L, H), with decay too; rows are folded within time segments, then segments in
order, so that no task holds all of a hot voxel's measurements. Distances need sums only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lattice
from .topology import XYZ, explode_neighbors, numbered, with_neighbor_values


@dataclass(frozen=True)
class Occupancy:
    """Thresholds on log-odds and their clamps, fixed values by default; clamp_p: whether probabilities are kept within [0.001, 0.999]."""

    occupied: float = 0.85
    free: float = -0.85
    low: float = -3.5
    high: float = 3.5
    clamp_p: bool = True


    @classmethod
    def of_probabilities(cls, occupied: float, free: float, **more) -> Occupancy:
        """Thresholds from probabilities."""
        import math

        at = lambda p: math.log(max(0.001, min(0.999, p)) / (1 - max(0.001, min(0.999, p))))
        return cls(at(occupied), at(free), **more)


PLAIN = Occupancy()
#: Fixed values of the decaying layer and of the layer in blocks.
TEMPORAL = Occupancy(0.847, -1.099, -3.466, 3.466, False)
BLOCKS = Occupancy(0.847, -1.099, -3.466, 3.466, False)


def log_odds(p: Column, clamp_p: bool = True) -> Column:
    if clamp_p:
        p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), p))
    return F.ln(p / (1 - p))


def probability(l: Column) -> Column:
    return 1 / (1 + F.exp(-l))


def state(l: Column, conf: Occupancy = PLAIN) -> Column:
    return F.when(l > conf.occupied, "Occupied").when(l < conf.free, "Free").otherwise("Unknown")


def occupancy(rows: DataFrame, conf: Occupancy = PLAIN, segment: str = "86400 seconds") -> DataFrame:
    """rows (x, y, z, ts, seq, occupied, confidence) to x, y, z, l, n."""
    d = log_odds(F.col("confidence"), conf.clamp_p)
    rows = rows.select(*XYZ, "ts", "seq", F.when(F.col("occupied"), d).otherwise(-d).alias("d"), F.window("ts", segment)["start"].alias("segment"))
    clamp = lambda v: F.greatest(F.lit(conf.low), F.least(F.lit(conf.high), v))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    step = lambda f, r: F.struct((f["a"] + r["d"]).alias("a"), clamp(f["lo"] + r["d"]).alias("lo"), clamp(f["hi"] + r["d"]).alias("hi"))
    folded = rows.groupBy(*XYZ, "segment").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "d"))).alias("r"), F.count("*").alias("n"))
    folded = folded.select(*XYZ, "segment", "n", F.aggregate("r", start, step).alias("f"))
    whole = folded.groupBy(*XYZ).agg(F.array_sort(F.collect_list(F.struct("segment", "f"))).alias("s"), F.sum("n").alias("n"))
    # A segment maps x to clamp(x + a, lo, hi).
    total = F.aggregate("s", F.lit(0.0), lambda x, s: F.greatest(s["f"]["lo"], F.least(s["f"]["hi"], x + s["f"]["a"])))
    return whole.select(*XYZ, total.alias("l"), "n")


def occupancy_stats(layer: DataFrame, conf: Occupancy = PLAIN) -> DataFrame:
    s = state(F.col("l"), conf)
    return layer.agg(
        F.count("*").alias("total"), F.count_if(s == "Occupied").alias("occupied"), F.count_if(s == "Free").alias("free"),
        F.count_if(s == "Unknown").alias("unknown"), F.sum("n").alias("measurements"),
    )


def temporal(rows: DataFrame, rate: float, conf: Occupancy = TEMPORAL, segment: str = "86400 seconds") -> DataFrame:
    """Evidence decays by exp(-rate dt) between measurements: x, y, z, l, last (seconds), n.

    A segment maps x, decayed until the segment's last measurement, to clamp(x + a, lo, hi).
    """
    p = F.col("confidence")
    d = F.ln(p / (1 - p))
    rows = rows.select(
        *XYZ, "ts", "seq", F.when(F.col("occupied"), d).otherwise(-d).alias("d"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.window("ts", segment)["start"].alias("segment"),
    )
    clamp = lambda v: F.greatest(F.lit(conf.low), F.least(F.lit(conf.high), v))
    folded = rows.groupBy(*XYZ, "segment").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "d", "t"))).alias("r"), F.count("*").alias("n"))
    first = F.col("r")[0]
    start = F.struct(first["d"].alias("a"), F.lit(conf.low).alias("lo"), F.lit(conf.high).alias("hi"), first["t"].alias("t"))

    def step(f, r):
        k = F.exp(-rate * (r["t"] - f["t"]))
        return F.struct((f["a"] * k + r["d"]).alias("a"), clamp(f["lo"] * k + r["d"]).alias("lo"), clamp(f["hi"] * k + r["d"]).alias("hi"), r["t"].alias("t"))

    folded = folded.select(*XYZ, "segment", "n", F.aggregate(F.slice("r", F.lit(2), F.size("r")), start, step).alias("f"))
    whole = folded.groupBy(*XYZ).agg(F.array_sort(F.collect_list(F.struct("segment", "f"))).alias("s"), F.sum("n").alias("n"))

    def join(x, s):
        old = x["l"] * F.coalesce(F.exp(-rate * (s["f"]["t"] - x["t"])), F.lit(1.0))
        return F.struct(F.greatest(s["f"]["lo"], F.least(s["f"]["hi"], old + s["f"]["a"])).alias("l"), s["f"]["t"].alias("t"))

    total = F.aggregate("s", F.struct(F.lit(0.0).alias("l"), F.lit(None).cast("double").alias("t")), join)
    return whole.select(*XYZ, total.alias("s"), "n").select(*XYZ, F.col("s.l").alias("l"), F.col("s.t").alias("last"), "n")


def temporal_state(layer: DataFrame, as_of: Column, rate: float, max_age: float, conf: Occupancy = TEMPORAL) -> DataFrame:
    """Adds decayed l, state (Unknown when older than max_age), probability (whatever the age) and stale."""
    age = as_of - F.col("last")
    now = F.col("l") * F.exp(-rate * age)
    return layer.select(*XYZ, "n", "last", now.alias("l"), F.when(age > max_age, "Unknown").otherwise(state(now, conf)).alias("state"), probability(now).alias("p"), (age > max_age).alias("stale"))


def prune_stale(layer: DataFrame, as_of: Column, max_age: float) -> DataFrame:
    return layer.filter(as_of - F.col("last") < max_age)


def temporal_stats(layer: DataFrame, as_of: Column, rate: float, max_age: float, conf: Occupancy = TEMPORAL) -> DataFrame:
    """Counts by decayed state, whatever the age, and of stale voxels. Nothing tracks motion, so that no voxel is dynamic."""
    age = as_of - F.col("last")
    s = state(F.col("l") * F.exp(-rate * age), conf)
    return layer.agg(
        F.count("*").alias("total"), F.count_if(s == "Occupied").alias("occupied"), F.count_if(s == "Free").alias("free"), F.count_if(s == "Unknown").alias("unknown"),
        F.lit(0).cast("long").alias("dynamic"), F.count_if(age > max_age).alias("stale"),
    )


def temporal_rays(rays: DataFrame, size: float, p_free: float, p_occupied: float, most: int = 1000) -> DataFrame:
    """rays (ray, sx .. sz, ex .. ez) to measurements, as the decaying layer takes them: floor voxels, one step for each voxel on the
    longest axis up to ``most``, rounded, without a move to the lattice; the end is occupied. Cells outside of 16 bits are left out."""
    a, b = ([F.floor(F.col(f"{e}{c}") / size).cast("long") for c in XYZ] for e in "se")
    rays = rays.select("ray", *[v.alias(f"a{c}") for v, c in zip(a, XYZ, strict=True)], *[v.alias(f"b{c}") for v, c in zip(b, XYZ, strict=True)])
    n = F.least(lattice.chebyshev(*[F.col(f"b{c}") - F.col(f"a{c}") for c in XYZ]), F.lit(most))
    steps = rays.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("step"))
    on = F.col("step") < F.col("n")
    at = [F.when(on, F.round(F.col(f"a{c}") + F.col("step") / F.col("n") * (F.col(f"b{c}") - F.col(f"a{c}")))).otherwise(F.col(f"b{c}")).cast("long").alias(c) for c in XYZ]
    out = steps.select("ray", "step", *at, (~on).alias("occupied"), F.when(on, p_free).otherwise(p_occupied).alias("confidence"))
    for c in XYZ:
        out = out.filter(F.col(c).between(0, 65535))
    return out


def block_occupancy(rows: DataFrame, size: int = 8) -> DataFrame:
    """The layer in dense blocks, by its own rules: logits as they are, its clamps and thresholds (BLOCKS)."""
    return blocks(occupancy(rows, BLOCKS), size)


def block_state(l: Column) -> Column:
    return state(l, BLOCKS)


def block_runs(held: DataFrame) -> DataFrame:
    """bx, by, bz and runs: (value, length) of equal values one after another."""
    zero = F.array().cast("array<struct<value:double,length:int>>")

    def step(out, v):
        last = F.element_at(out, -1)
        same = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["value"] == v)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["value"].alias("value"), (last["length"] + 1).alias("length"))))
        return F.when(same, longer).otherwise(F.concat(out, F.array(F.struct(v.alias("value"), F.lit(1).alias("length")))))

    return held.select("bx", "by", "bz", F.aggregate("values", zero, step).alias("runs"))


def unrun_blocks(runs: DataFrame) -> DataFrame:
    return runs.select("bx", "by", "bz", F.flatten(F.transform("runs", lambda r: F.array_repeat(r["value"], r["length"]))).alias("values"))


def compression_stats(held: DataFrame) -> DataFrame:
    """Blocks as runs of eight bytes against four bytes a value: bytes, ratio (1 without blocks) and megabytes saved."""
    v = F.col("values")
    turns = F.size(F.filter(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.get(v, i) != F.get(v, i - 1))) + 1
    sums = held.select((turns * 8).cast("long").alias("packed"), (F.size(v) * 4).cast("long").alias("full"))
    sums = sums.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("packed"), F.lit(0)).alias("packed"), F.coalesce(F.sum("full"), F.lit(0)).alias("full"))
    ratio = F.when(F.col("packed") == 0, 1.0).otherwise(F.col("full") / F.col("packed"))
    return sums.select("*", ratio.alias("ratio"), ((F.col("full") - F.col("packed")) / 1048576.0).alias("saved_mb"))


def measurements(rows: DataFrame) -> DataFrame:
    """Measurements (kind: depth, occupancy, color or intensity; confidence; ...) with the confidence within [0, 1]."""
    known = F.col("kind").isin("depth", "occupancy", "color", "intensity")
    rows = rows.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no such measurement: "), F.coalesce("kind", F.lit("null"))))))
    return rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))


def dispatch(rows: DataFrame, layer: str) -> DataFrame:
    """Which measurements a layer takes: occupancy leaves all others, tsdf raises on them, esdf takes none."""
    if layer == "occupancy":
        return rows.filter("kind = 'occupancy'")
    if layer == "tsdf":
        depth = F.when(F.col("kind") == "depth", F.col("kind")).otherwise(F.raise_error("a distance layer takes depths only"))
        return rows.withColumn("kind", depth)
    if layer == "esdf":
        return rows.limit(0)
    raise ValueError(f"no layer {layer}")


def blocks(layer: DataFrame, size: int = 8) -> DataFrame:
    """Dense blocks: bx, by, bz and size**3 values, x fastest; cells without evidence are 0."""
    at = (F.col("x") % size + F.col("y") % size * size + F.col("z") % size * size * size).cast("int")
    keys = [F.floor(F.col(c) / size).cast("long").alias(f"b{c}") for c in XYZ]
    held = layer.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at, "l"))).alias("m"), F.count("*").alias("n"))
    return held.select("bx", "by", "bz", "n", F.transform(F.sequence(F.lit(0), F.lit(size**3 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("values"))


def run_lengths(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values by keys: run, value, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    out = df.withColumn("run", F.sum(new.cast("int")).over(w)).groupBy(*keys, "run")
    return out.agg(F.first(value).alias(value), F.count("*").alias("length"))


def decode_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, "run", F.posexplode(F.array_repeat(F.col(value), F.col("length").cast("int"))).alias("pos", value))


def _no_nan(value: str) -> Column:
    return F.when(F.isnan(value), F.raise_error("NaN in layer").cast("double")).otherwise(F.col(value))


def aggregate(cells: DataFrame, layer: DataFrame, value: str = "value") -> DataFrame:
    """Count, sum, mean, min, max and median of the layer's values at cells; repeated cells count again, missing ones don't.
    NaN raises, but for the count; so does a set of cells of which none is there.

    The median comes from a sort by ranges: its middle rows are the only ones that meet.
    """
    good = _no_nan(value)
    held = cells.select(*XYZ).join(layer, XYZ).select(value)
    some = F.when(F.count("*") > 0, F.count("*")).otherwise(F.raise_error("no cells to aggregate").cast("long"))
    out = held.agg(some.cast("double").alias("count"), F.sum(good).alias("sum"), F.avg(good).alias("mean"), F.min(good).alias("min"), F.max(good).alias("max"))
    ranked = numbered(held.filter(F.col(value).isNotNull()), [value])
    n = ranked.agg(F.max("place").alias("n"))
    middle = ranked.join(F.broadcast(n), F.col("place").isin(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    return out.crossJoin(F.broadcast(middle.agg(F.avg(value).alias("median"))))  # one row


def rollup(layer: DataFrame, value: str = "value", levels: int = 1) -> DataFrame:
    """Values by lattice parent, ``levels`` up. NaN raises, but for the count. With a column resolution, cells that reach 0 before
    their last step drop out, and the others' is less by ``levels``."""
    graded = "resolution" in layer.columns
    keys = [*XYZ, "resolution"] if graded else XYZ
    for _ in range(levels):
        p = lattice.parent(F.col("x"), F.col("y"), F.col("z"))
        if graded:
            layer = layer.filter("resolution > 0").withColumn("resolution", F.col("resolution") - 1)
        layer = layer.select(*[c.alias(n) for c, n in zip(p, XYZ, strict=True)], *[c for c in layer.columns if c not in XYZ])
    v = _no_nan(value)
    return layer.groupBy(*keys).agg(F.count("*").alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, 0.5).alias("median"))


def get(layer: DataFrame, cells: DataFrame) -> DataFrame:
    """A layer's values at cells, null where there are none, and whether the cell is there."""
    return cells.select(*XYZ).join(layer.withColumn("there", F.lit(True)), XYZ, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def remove(layer: DataFrame, cells: DataFrame) -> DataFrame:
    return layer.join(cells.select(*XYZ).distinct(), XYZ, "left_anti")


def upsert(layer: DataFrame, order: str, value: str = "value") -> DataFrame:
    """The last value of each cell."""
    return layer.groupBy(*XYZ).agg(F.max_by(value, order).alias(value))


def integrate_rays(rays: DataFrame, size: float, p_free: float, p_occupied: float) -> DataFrame:
    """rays (ray, sx, sy, sz, ex, ey, ez) to measurements (ray, step, x, y, z, occupied, confidence): every half voxel is free,
    the end occupied; cells outside of 16 bits are left out, rays under a micron are nothing."""
    d = [F.col(f"e{c}") - F.col(f"s{c}") for c in XYZ]
    length = F.sqrt(sum((v * v for v in d), F.lit(0.0)))
    n = F.floor(length / (size / 2)).cast("long")
    rays = rays.filter(length >= 1e-6)
    steps = rays.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))).alias("step"))
    at = [F.col(f"s{c}") + v / length * (F.col("step") * (size / 2)) for c, v in zip(XYZ, d, strict=True)]
    free = steps.select("ray", "step", *[v.alias(c) for v, c in zip(lattice.physical_to_voxel(*at, size), XYZ, strict=True)], F.lit(False).alias("occupied"), F.lit(p_free).alias("confidence"))
    ends = lattice.physical_to_voxel(*[F.col(f"e{c}") for c in XYZ], size)
    last = rays.select("ray", n.alias("step"), *[v.alias(c) for v, c in zip(ends, XYZ, strict=True)], F.lit(True).alias("occupied"), F.lit(p_occupied).alias("confidence"))
    out = free.unionByName(last)
    for c in XYZ:
        out = out.filter(F.col(c).between(0, 65535))
    return out


def tsdf(rows: DataFrame, truncation: float = 0.1, max_weight: float = 100.0) -> DataFrame:
    """rows (x, y, z, sdf, weight from 0 on, seq) to x, y, z, distance, w, n. The weight is capped before it divides.

    Distance times weight therefore grows by sdf times weight at each step, capped or not, and plain sums give the fold's
    result. Two cases aside, for which seq counts: the first weight is capped itself, and without any weight the last sdf stays.
    """
    first = F.when(F.col("weight") > 0, F.col("seq"))
    held = rows.filter(F.abs("sdf") <= truncation).groupBy(*XYZ).agg(
        F.sum(F.col("sdf") * F.col("weight")).alias("dw"), F.sum("weight").alias("all"), F.min_by("sdf", first).alias("d1"), F.min_by("weight", first).alias("w1"),
        F.max_by("sdf", "seq").alias("last"), F.count("*").alias("n"),
    )
    w = F.least("all", F.lit(max_weight))
    over = F.greatest(F.col("w1") - max_weight, F.lit(0.0)) * F.col("d1")
    return held.select(*XYZ, F.when(F.col("all") > 0, (F.col("dw") - over) / w).otherwise(F.col("last")).alias("distance"), w.alias("w"), "n")


def depth_rays(rows: DataFrame, size: float) -> DataFrame:
    """sdf = depth less the voxel's distance from the sensor (sx, sy, sz)."""
    far = F.sqrt(sum(((F.col(c) * size - F.col(f"s{c}")) * (F.col(c) * size - F.col(f"s{c}")) for c in XYZ), F.lit(0.0)))
    return rows.withColumn("sdf", F.col("depth") - far)


def tsdf_stats(layer: DataFrame, size: float = 0.02) -> DataFrame:
    seen = F.col("w") > 0
    return layer.agg(
        F.count("*").alias("total"), F.coalesce(F.min(F.when(seen, F.col("distance"))), F.lit(0.0)).alias("least"), F.coalesce(F.max(F.when(seen, F.col("distance"))), F.lit(0.0)).alias("most"),
        F.count_if(seen & (F.abs("distance") < size)).alias("surface"), F.avg("w").alias("mean_weight"),
    )


def surface(layer: DataFrame, threshold: float) -> DataFrame:
    return layer.filter((F.abs("distance") < threshold) & (F.col("w") > 0))


def zero_crossings(layer: DataFrame) -> DataFrame:
    """Edges between neighbours of opposite sign, once each (lower Morton code first): x .. z, nx .. nz, distance, n_value, t."""
    pairs = with_neighbor_values(layer.filter("w > 0").select(*XYZ, "distance"), "distance").filter("distance * n_value < 0")
    pairs = pairs.filter(lattice.morton_less(tuple(F.col(c) for c in XYZ), tuple(F.col(f"n{c}") for c in XYZ)))
    change = F.col("n_value") - F.col("distance")
    t = F.when(F.abs(change) > 1e-6, -F.col("distance") / change).otherwise(0.5)
    return pairs.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def mesh_vertices(layer: DataFrame, size: float) -> DataFrame:
    """A vertex on each crossing edge: x .. nz, vx, vy, vz."""
    e = zero_crossings(layer)
    at = [((F.col(c) + F.col("t") * (F.col(f"n{c}") - F.col(c))) * size).alias(f"v{c}") for c in XYZ]
    return e.select(*XYZ, "nx", "ny", "nz", *at)


def with_normals(vertices: DataFrame, layer: DataFrame, size: float) -> DataFrame:
    """Adds gx, gy, gz: the normal at the edge's first voxel, null where the field is flat."""
    return vertices.join(gradient(layer.filter("w > 0"), scale=size), XYZ, "left")


def numbered_mesh(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with vid, from 0 in the order of their edges, and triangles as tid and three of these."""
    names = [*XYZ, "nx", "ny", "nz"]
    v = numbered(vertices, names, "vid").withColumn("vid", F.col("vid") - 1)
    ids = v.select(F.struct(*names).alias("e"), "vid")
    out = triangles
    for n in "abc":
        out = out.join(ids.select(F.col("e").alias(n), F.col("vid").alias(f"v{n}")), n).drop(n)
    out = numbered(out.select(*[F.col(f"v{n}").alias(n) for n in "abc"]), ["a", "b", "c"], "tid")
    return v, out.withColumn("tid", F.col("tid") - 1)


def mesh_stats(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Counts, area and box of a mesh."""
    box = [f(f"v{c}").alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in XYZ]
    return vertices.agg(F.count("*").alias("vertices"), *box).crossJoin(surface_area(triangles, vertices))  # one row each


def mesh_triangles(vertices: DataFrame) -> DataFrame:
    """All triples of crossing edges at a voxel, once each: a, b, c (edges as structs, ascending)."""
    edge = F.struct(*[F.col(c) for c in (*XYZ, "nx", "ny", "nz")])
    ends = vertices.select(F.explode(F.array(F.struct(*XYZ), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z")))).alias("at"), edge.alias("e"))
    # At most 14 edges meet at a voxel, so a triple costs no more than 364 rows.
    at = ends.groupBy("at").agg(F.array_sort(F.collect_set("e")).alias("e")).filter(F.size("e") >= 3)
    a = at.select("e", F.posexplode("e").alias("i", "a"))
    b = a.select("e", "a", F.posexplode("e").alias("j", "b"), "i").filter("j > i")
    c = b.select("a", "b", F.posexplode("e").alias("k", "c"), "j").filter("k > j")
    return c.select("a", "b", "c").distinct()


def surface_area(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    v = vertices.select(F.struct(*XYZ, "nx", "ny", "nz").alias("e"), F.array("vx", "vy", "vz").alias("p"))
    out = triangles
    for n in "abc":
        out = out.join(v.select(F.col("e").alias(n), F.col("p").alias(f"p{n}")), n)
    u = [F.col("pb")[i] - F.col("pa")[i] for i in range(3)]
    w = [F.col("pc")[i] - F.col("pa")[i] for i in range(3)]
    cross = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    return out.agg(F.count("*").alias("triangles"), F.sum(0.5 * F.sqrt(sum((c * c for c in cross), F.lit(0.0)))).alias("area"))


def gradient(layer: DataFrame, value: str = "distance", scale: float = 1.0) -> DataFrame:
    """Mean of (neighbour - own) times the offset over neighbours that are there, normalised: gx, gy, gz (none if flat)."""
    pairs = with_neighbor_values(layer.select(*XYZ, value), value)
    g = [F.avg((F.col("n_value") - F.col(value)) * (F.col(f"n{c}") - F.col(c)) * scale).alias(f"g{c}") for c in XYZ]
    out = pairs.groupBy(*XYZ).agg(*g)
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz"))
    return out.withColumn("m", size).filter("m > 1e-6").select(*XYZ, *[(F.col(f"g{c}") / F.col("m")).alias(f"g{c}") for c in XYZ])


def esdf(layer: DataFrame, size: float, max_distance: float, threshold: float) -> DataFrame:
    """Distance to the nearest surface voxel over edges: x, y, z, distance (signed, at most max_distance).

    Without obstacles the way's length has a closed form, so that each surface voxel reaches its neighbourhood by a table of
    offsets and a voxel keeps its least. Voxels one edge beyond those that still push are there too, clamped."""
    import math

    near = surface(layer, threshold).select(*XYZ, F.col("distance").alias("own"))
    steps = max(1, math.ceil(max_distance / size / 3**0.5) + 1)
    reach = [(a, b, c) for a, b, c, _ in lattice.ring_offsets(steps)]
    costs = []
    for a, b, c in reach:
        _, mid, top = sorted((abs(a), abs(b), abs(c)))
        costs.append((a, b, c, 3**0.5 * mid + (top - mid)))
    pushing = max_distance - 3**0.5 * size
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(float(d)).alias("d")) for a, b, c, d in costs if d * size <= max_distance + 2 * size])
    spread = near.select("own", *XYZ, F.explode(table).alias("o"))
    spread = spread.select(*[(F.col(c) + F.col(f"o.{n}")).alias(c) for c, n in zip(XYZ, "abc", strict=True)], "own", (F.col("o.d") * size).alias("way"))
    for c in XYZ:
        spread = spread.filter(F.col(c).between(0, 65535))
    total = F.when(F.col("way") == 0, F.abs("own")).otherwise(F.abs("own") + F.col("way"))
    best = spread.groupBy(*XYZ).agg(F.min(F.struct(total.alias("m"), F.when(F.col("own") < 0, -1.0).otherwise(1.0).alias("sign"))).alias("b"), F.min(F.when(F.col("way") == 0, F.col("own"))).alias("own"))
    best = best.select(*XYZ, F.col("b.m").alias("m"), F.col("b.sign").alias("sign"), "own")
    sources = best.filter((F.col("m") <= pushing) | F.col("own").isNotNull())
    domain = explode_neighbors(sources.select(*XYZ), 0, 65535).select(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z")).unionByName(sources.select(*XYZ)).distinct()
    value = F.coalesce("own", F.col("sign") * F.least(F.col("m"), F.lit(max_distance)))
    return best.join(domain, XYZ, "left_semi").select(*XYZ, value.alias("distance"))


def within_distance(field: DataFrame, threshold: float) -> DataFrame:
    return field.filter(F.abs("distance") <= threshold)


def is_free_space(distance: Column, threshold: float) -> Column:
    """Whether a voxel is further outside than threshold; one that isn't in the field isn't."""
    return F.coalesce(distance > threshold, F.lit(False))


def esdf_stats(layer: DataFrame) -> DataFrame:
    return layer.agg(F.count("*").alias("total"), F.count_if(F.col("distance") < 0).alias("inside"), F.count_if(F.col("distance") >= 0).alias("outside"), F.min("distance").alias("least"), F.max("distance").alias("most"))


def frontier_voxels(layer: DataFrame, conf: Occupancy = PLAIN) -> DataFrame:
    """Unknown voxels (never seen, or seen without a verdict) next to free ones."""
    known = layer.select(*XYZ, state(F.col("l"), conf).alias("s"))
    free = known.filter("s = 'Free'").select(*XYZ)
    beside = explode_neighbors(free, 0, 65535).select(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z")).distinct()
    return beside.join(known.filter("s <> 'Unknown'").select(*XYZ), XYZ, "left_anti")


def frontiers(layer: DataFrame, min_size: int = 5, conf: Occupancy = PLAIN, size: float = 1.0) -> DataFrame:
    """Clusters of frontier voxels that touch: cluster, n, cx, cy, cz, low and high corners, and area (of one face a voxel)."""
    from ..functions.ids import morton
    from .topology import components, shared

    cells = shared(frontier_voxels(layer, conf).withColumn("key", morton(*[F.col(c) for c in XYZ])), "frontier")
    links = with_neighbor_values(cells, "key").filter("key < n_value").select(F.col("key").alias("a"), F.col("n_value").alias("b"))
    named = cells.join(components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("cluster", F.coalesce("component", "key"))
    parts = [f(F.col(c) * size).alias(f"{n}{c}") for n, f in (("c", F.avg), ("low_", F.min), ("high_", F.max)) for c in XYZ]
    return named.groupBy("cluster").agg(F.count("*").alias("n"), *parts, (F.count("*") * (size * size)).alias("area")).filter(F.col("n") >= min_size)


def view_directions(fov: float, step: float) -> list[tuple[float, float]]:
    """Yaw and pitch of a field of view's rays, in radians."""
    n = int(fov / 2 / step)
    return [(i * step, j * step) for i in range(-n, n + 1) for j in range(-n, n + 1)]


def information_gain(views: DataFrame, layer: DataFrame, size: float = 1.0, reach: float = 5.0, fov: float = 1.0471975511965976, step: float = 0.08726646259971647, weight: float = 1.0, conf: Occupancy = PLAIN) -> DataFrame:
    """views (view, px, py, pz, dx, dy, dz) to view, gain: unknown voxels that a view's rays pass, each once, times weight."""
    rays = F.array(*[F.struct(F.lit(a).alias("yaw"), F.lit(b).alias("pitch")) for a, b in view_directions(fov, step)])
    v = views.select("*", F.explode(rays).alias("r"))
    yaw, pitch = F.col("r.yaw"), F.col("r.pitch")
    dx = F.col("dx") * F.cos(yaw) - F.col("dy") * F.sin(yaw)
    dy = F.col("dx") * F.sin(yaw) + F.col("dy") * F.cos(yaw)
    dz = F.col("dz") + F.sin(pitch)
    long = F.sqrt(dx * dx + dy * dy + dz * dz)
    unit = [F.when(long < 0.001, F.lit(w)).otherwise(d / long) for d, w in ((dx, 0.0), (dy, 0.0), (dz, 1.0))]
    v = v.select("view", "px", "py", "pz", *[u.alias(f"u{c}") for u, c in zip(unit, XYZ, strict=True)], F.explode(F.sequence(F.lit(1), F.lit(int(reach / (size / 2))))).alias("i"))
    at = [F.col(f"p{c}") + F.col(f"u{c}") * (F.col("i") * (size / 2)) for c in XYZ]
    cells = v.select("view", *[p.alias(c) for p, c in zip(lattice.physical_to_voxel(*at, size), XYZ, strict=True)]).distinct()
    known = layer.select(*XYZ, state(F.col("l"), conf).alias("s")).filter("s <> 'Unknown'").select(*XYZ)
    seen = cells.join(known, XYZ, "left_anti").groupBy("view").agg((F.count("*") * weight).alias("gain"))
    return views.select("view").join(seen, "view", "left").select("view", F.coalesce("gain", F.lit(0.0)).alias("gain"))


def viewpoints(clusters: DataFrame) -> DataFrame:
    """24 poses around each cluster (radii 1, 2, 3; 8 angles) that look at its centroid: view, cluster, px .. pz, dx .. dz."""
    poses = F.array(*[F.struct(F.lit(float(r)).alias("r"), F.lit(a * 0.7853981633974483).alias("a"), F.lit(r * 8 + a).alias("i")) for r in (1, 2, 3) for a in range(8)])
    v = clusters.select("cluster", "cx", "cy", "cz", F.explode(poses).alias("o"))
    px, py = F.col("cx") + F.col("o.r") * F.cos("o.a"), F.col("cy") + F.col("o.r") * F.sin("o.a")
    return v.select(F.concat_ws(":", "cluster", "o.i").alias("view"), "cluster", px.alias("px"), py.alias("py"), F.col("cz").alias("pz"), ((F.col("cx") - px) / F.col("o.r")).alias("dx"), ((F.col("cy") - py) / F.col("o.r")).alias("dy"), F.lit(0.0).alias("dz"))


class LayeredMap:
    """Layers by name, at most one of each; all are keyed by x, y, z."""

    def __init__(self):
        self.layers: dict[str, DataFrame] = {}

    def add(self, name: str, layer: DataFrame) -> None:
        if name in self.layers:
            raise ValueError(f"{name} is there")
        self.layers[name] = layer

    def update(self, name: str, change) -> None:
        """Replaces a layer by what change makes of it; a layer that isn't there raises."""
        if name not in self.layers:
            raise KeyError(name)
        self.layers[name] = change(self.layers[name])

    def layer_types(self) -> list[str]:
        return sorted(self.layers)

    def clear(self) -> None:
        self.layers.clear()

    def remove(self, name: str) -> DataFrame | None:
        return self.layers.pop(name, None)

    def query(self, voxels: DataFrame) -> DataFrame:
        """All layers' columns at voxels, named layer_column; null where a layer has none."""
        out = voxels.select(*XYZ)
        for name, layer in self.layers.items():
            out = out.join(layer.select(*XYZ, *[F.col(c).alias(f"{name}_{c}") for c in layer.columns if c not in XYZ]), XYZ, "left")
        return out

    def total_voxels(self) -> int:
        return sum(layer.count() for layer in self.layers.values())

    def memory_bytes(self) -> int:
        """As the layers state it: 40 bytes a voxel."""
        return 40 * self.total_voxels()
