"""Neighbours, rings, lines, paths and spanning trees over cells, as explodes and equi-joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import ids, lattice
from ..runtime import python_rows, spread

XYZ = ["x", "y", "z"]
#: Samples of lines that are held at once, 1 MB for each of some twenty arrays.
SAMPLES = 1 << 17


def _c(*names):
    return [F.col(n) for n in names]


def shared(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a table in the folder that spark.checkpoint.dir names; one of this machine only where all work runs in this process."""
    return df.sparkSession.read.schema(df.schema).parquet(shared_path(df, label))


def shared_path(df: DataFrame, label: str) -> str:
    spark = df.sparkSession
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not folder:
        import tempfile

        if conf.get("spark.master", "").split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Rows numbered from 1 in a total order: a sort by ranges, and the counts of the ranges before, so that no task has all rows."""
    rows = shared(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    out = rows.join(F.broadcast(counts), part == F.col("__part"))
    return out.withColumn(name, F.col("__before") + F.expr("__at & 8589934591") + 1).drop("__at", "__part", "__before")


def explode_neighbors(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """A row for each neighbour: slot (0 to 13), nx, ny, nz; only those within [low, high] on each axis."""
    out = df.select("*", F.posexplode(lattice.neighbors(*_c(*XYZ))).alias("slot", "n"))
    out = out.select(*df.columns, "slot", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), F.col("n.z").alias("nz"))
    if low is not None:
        for c in ("nx", "ny", "nz"):
            out = out.filter(F.col(c).between(low, high))
    return out


def with_neighbor_values(df: DataFrame, value: str, low: int = 0, high: int = 65535) -> DataFrame:
    """Pairs of neighbours that both are in df, with the neighbour's value as n_value."""
    right = df.select(*[F.col(c).alias(f"n{c}") for c in XYZ], F.col(value).alias("n_value"))
    return explode_neighbors(df, low, high).join(right, ["nx", "ny", "nz"])


def ring(df: DataFrame, k: int, shell: bool = False) -> DataFrame:
    """Cells within k steps (or at k) of each row's cell: ox, oy, oz and hop. Rings are tables of offsets, of 2,465 rows at k = 8."""
    offsets = [o for o in lattice.ring_offsets(k) if not shell or o[3] == k]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("a", "b", "c", "hop"), strict=True)]) for o in offsets])
    out = df.select("*", F.explode(table).alias("o"))
    return out.select(*df.columns, (F.col("x") + F.col("o.a")).alias("ox"), (F.col("y") + F.col("o.b")).alias("oy"), (F.col("z") + F.col("o.c")).alias("oz"), F.col("o.hop").alias("hop"))


def radius(df: DataFrame, r: float) -> DataFrame:
    """Cells within Euclidean distance r."""
    k = int(r) + 1
    table = [o for o in lattice.ring_offsets(k) if o[0] ** 2 + o[1] ** 2 + o[2] ** 2 <= r * r]
    out = df.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c, _ in table])).alias("o"))
    return out.select(*df.columns, (F.col("x") + F.col("o.a")).alias("ox"), (F.col("y") + F.col("o.b")).alias("oy"), (F.col("z") + F.col("o.c")).alias("oz"))


def _round(v: np.ndarray) -> np.ndarray:
    """Halves go away from zero."""
    whole = np.trunc(v)
    return np.where(np.abs(v - whole) >= 0.5, whole + np.copysign(1.0, v), whole)


def _sampled(steps: np.ndarray, start: list[np.ndarray], by: list[np.ndarray], end: list[np.ndarray], known: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each row's line: how many points, their coordinates, and where these are null (of a point that isn't finite or is out of range)."""
    rows = np.repeat(np.arange(len(steps)), steps + 2)  # the samples, and the end
    first = np.cumsum(steps + 2) - (steps + 2)
    i = np.arange(len(rows)) - first[rows]
    part = i / steps[rows]
    at = [s[rows] + d[rows] * part for s, d in zip(start, by, strict=True)]
    good = np.logical_and.reduce([np.abs(c) <= float(2**31 - 2) for c in at])  # as nearest_point(); false for NaN
    at = [np.where(good, c, 0.0) for c in at]
    even, uneven = [_round(c / 2) * 2 for c in at], [_round((c - 1) / 2) * 2 + 1 for c in at]
    far = lambda p: sum((a - b) * (a - b) for a, b in zip(p, at, strict=True))
    nearer = far(even) <= far(uneven)
    last = i > steps[rows]
    out, null = [], []
    for a, b, e, k in zip(even, uneven, end, known, strict=True):
        point = np.where(nearer, a, b).astype(np.int64) * good
        point[last] = e
        there = good.copy()
        there[last] = k
        out.append(point)
        null.append(~there)
    new = i == 0
    for values in (*out, *null):
        new[1:] |= values[1:] != values[:-1]
    return np.bincount(rows[new], minlength=len(steps)), [c[new] for c in out], [c[new] for c in null]


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of the rows; then steps, start, difference and end. Rows of SAMPLES samples at once; a longer line alone."""
    for batch in batches:
        kept = batch.num_columns - 10
        steps = batch.column(kept).to_numpy(zero_copy_only=False)
        floats = [batch.column(kept + k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(1, 7)]  # null: NaN
        ends = [batch.column(kept + k) for k in range(7, 10)]
        known = [e.is_valid().to_numpy(zero_copy_only=False) for e in ends]
        ends = [e.fill_null(0).to_numpy(zero_copy_only=False) for e in ends]
        total, a = np.cumsum(steps + 2), 0
        while a < len(steps):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SAMPLES, "right")))
            cut = lambda columns: [c[a:b] for c in columns]  # noqa: B023, E731
            n, points, null = _sampled(steps[a:b], cut(floats[:3]), cut(floats[3:]), cut(ends), cut(known))
            at = pa.StructArray.from_arrays([pa.array(c, pa.int64(), mask=m) for c, m in zip(points, null, strict=True)], XYZ)
            line = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), at)
            held = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*held.columns[:kept], line], [*batch.schema.names[:kept], "line"])
            a = b


def trace_lines(df: DataFrame, start: list, end: list) -> DataFrame:
    """Adds line: points from start to end, sampled at half the largest step, snapped, without repeats in a row, the end forced.
    Sampled in Python over arrays of many lines, as lambdas would run for each point uncompiled."""
    by = [e - s for s, e in zip(start, end, strict=True)]
    steps = F.greatest(lattice.chebyshev(*by) * 2, F.lit(1).cast("long"))
    double = [c.cast("double") for c in (*start, *by)]
    schema = StructType([*df.schema.fields, *StructType.fromDDL("line array<struct<x:bigint,y:bigint,z:bigint>>").fields])
    parts = [c.alias(f"__{k}") for k, c in enumerate([steps, *double, *[e.cast("long") for e in end]])]
    return python_rows(spread(df).select("*", *parts), _line_rows, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): least labels spread with pointer jumping until nothing changes."""
    both = shared(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = shared(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = shared(moved.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "was"), "labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> was").isEmpty():
            return labels


def euclidean(cells: dict[str, Column], near: dict[str, Column]) -> Column:
    """The plain cost of a step."""
    return lattice.euclid(*[near[c] - cells[c] for c in XYZ])


def shortest_paths(free: DataFrame, starts: DataFrame, max_steps: int = 10_000, cost: Callable | None = None, goals: DataFrame | None = None) -> DataFrame:
    """Least cost over edges between free cells from each start (id, x, y, z): id, x, y, z, cost, px, py, pz (the cell
    before). Frontiers relax level by level; a cell re-enters while it gets cheaper, so obstacles need no ordering.
    A start needn't be free. cost: from two dicts of coordinates, and the neighbour's columns in free, to a Column; null or infinite
    is no way. goals (id, x, y, z): cells that can't be on a cheaper way to the goal, by the straight distance, are left;
    use them only where no step costs less than its length. Reaching max_steps raises."""
    zero = F.lit(0.0)
    none = [F.lit(None).cast("long").alias(n) for n in ("px", "py", "pz")]
    # Each level adds its own rows; what a cell costs so far is the least of them.
    first = starts.select("id", *XYZ, zero.alias("cost"), *none)
    levels = [shared_path(first, "paths")]
    read = lambda paths: starts.sparkSession.read.schema(first.schema).parquet(*paths)
    frontier = read(levels)
    others = [c for c in free.columns if c not in XYZ] if cost else []
    held = shared(free.select(*XYZ, *others).dropDuplicates(XYZ), "free")
    for _ in range(max_steps):
        reached = explode_neighbors(frontier.select("id", *[F.col(c) for c in XYZ], "cost"))
        reached = reached.select("id", F.col("cost").alias("so_far"), *[F.col(c).alias(f"p{c}") for c in XYZ], *[F.col(f"n{c}").alias(c) for c in XYZ]).join(held, XYZ)
        step = (cost or euclidean)({c: F.col(f"p{c}") for c in XYZ}, {c: F.col(c) for c in XYZ})
        reached = reached.select("id", *XYZ, (F.col("so_far") + step).alias("cost"), "px", "py", "pz").filter("cost < double('infinity')")
        reached = reached.groupBy("id", *XYZ).agg(F.min(F.struct("cost", "px", "py", "pz")).alias("w")).select("id", *XYZ, "w.*")
        old = read(levels).groupBy("id", *XYZ).agg(F.min("cost").alias("old"))
        frontier = reached.join(old, ["id", *XYZ], "left").filter(F.col("old").isNull() | (F.col("cost") < F.col("old") - 1e-9)).drop("old")
        if goals is not None:
            g = goals.select("id", *[F.col(c).alias(f"g{c}") for c in XYZ])
            ends = g.join(old.select(F.col("id").alias("i"), *[F.col(c).alias(f"b{c}") for c in XYZ], F.col("old").alias("most")), (F.col("id") == F.col("i")) & (F.col("gx") == F.col("bx")) & (F.col("gy") == F.col("by")) & (F.col("gz") == F.col("bz")), "left")
            frontier = frontier.join(ends.select("id", "gx", "gy", "gz", "most"), "id")
            left = lattice.euclid(*[F.col(f"g{c}") - F.col(c) for c in XYZ])
            frontier = frontier.filter(F.col("most").isNull() | (F.col("cost") + left < F.col("most") + 1e-9)).select(*reached.columns)
        path = shared_path(frontier.select(*first.columns), "paths")
        frontier = read([path])
        if frontier.isEmpty():
            least = F.min(F.struct("cost", "px", "py", "pz")).alias("w")
            return shared(read(levels).groupBy("id", *XYZ).agg(least).select("id", *XYZ, "w.*"), "paths")
        levels.append(path)
    raise RuntimeError("search limit exceeded")


def find_paths(free: DataFrame, asked: DataFrame, max_steps: int = 10_000, cost: Callable | None = None) -> DataFrame:
    """asked (id, x, y, z, gx, gy, gz) to id, status (ok or NoPathFound), cost, hops and path: cells from start to goal.

    Predecessors are followed back from all goals at once, a step a round. A start that is the goal is a path of cost 0.
    """
    goals = asked.select("id", *[F.col(f"g{c}").alias(c) for c in XYZ])
    best = shortest_paths(free, asked.select("id", *XYZ), max_steps, cost, goals)
    at = lambda *names: F.struct(*[F.col(n).cast("long").alias(c) for n, c in zip(names, XYZ, strict=True)])
    ends = shared(goals.join(best, ["id", *XYZ]).select("id", "cost", F.array(at(*XYZ)).alias("path"), "px", "py", "pz"), "ends")
    done = ends.filter("px is null")
    back = best.select("id", F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("pz").alias("qz"), *XYZ)
    while not (ends := ends.filter("px is not null")).isEmpty():
        longer = ends.select("id", "cost", F.concat(F.array(at("px", "py", "pz")), "path").alias("path"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
        ends = shared(longer.join(back, ["id", *XYZ]).select("id", "cost", "path", F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("qz").alias("pz")), "ends")
        done = done.unionByName(ends.filter("px is null"))
    found = done.select("id", "cost", (F.size("path") - 1).alias("hops"), "path")
    return asked.select("id").join(found, "id", "left").select("id", F.when(F.col("path").isNull(), "NoPathFound").otherwise("ok").alias("status"), "cost", "hops", "path")


def path_is_valid(path: Column) -> Column:
    """Whether each cell of a path is a neighbour of the one before."""
    steps = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: lattice.hops(*[F.element_at(path, i + 1)[c] - F.element_at(path, i)[c] for c in XYZ]) == 1)
    return F.when(F.size(path) > 1, F.forall(steps, lambda ok: ok)).otherwise(F.lit(True))


def bfs_levels(edges: DataFrame, starts: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """edges (a, b), both ways; starts (node): node and hops from the nearest start. Reaching max_steps raises."""
    both = shared(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    seen = frontier = shared(starts.select("node", F.lit(0).alias("hops")).distinct(), "levels")
    for k in range(1, max_steps + 1):
        near = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = shared(near.join(seen, "node", "left_anti").select("node", F.lit(k).alias("hops")), "level")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)  # files only, one a level
    raise RuntimeError("search limit exceeded")


def furthest_corner(cells: DataFrame, points: DataFrame, extent: tuple[int, int, int]) -> DataFrame:
    """points (id, x, y, z) to id and sx, sy, sz: the cell nearest to the corner of the box that is furthest from the point.

    Of equal corners the first counts (x, then y, then z; 0 first), of equal cells the least. Eight corners ask, not all points.
    """
    corners = [tuple((n - 1) * (i >> k & 1) for n, k in zip(extent, (2, 1, 0), strict=True)) for i in range(8)]
    far = [lattice.euclid_squared(*[F.col(c) - F.lit(v) for c, v in zip(XYZ, corner, strict=True)]) for corner in corners]
    which = F.array_position(F.array(*far), F.greatest(*far)) - 1
    eight = cells.sparkSession.createDataFrame([(i, *map(int, c)) for i, c in enumerate(corners)], "corner long, kx long, ky long, kz long")
    near = cells.select(*XYZ).crossJoin(F.broadcast(eight))  # eight rows
    d = lattice.euclid_squared(*[F.col(c) - F.col(f"k{c}") for c in XYZ])
    near = near.groupBy("corner").agg(F.min(F.struct(d.alias("d"), *XYZ)).alias("s")).select("corner", *[F.col(f"s.{c}").alias(f"s{c}") for c in XYZ])
    return points.select("id", which.alias("corner")).join(F.broadcast(near), "corner").drop("corner")


def spanning_tree(edges: DataFrame, seed: int = 0) -> DataFrame:
    """A spanning forest of edges (a, b) with hashed weights, by Borůvka's rounds: the same for the same seed."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    weight = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "a", "b")), 1, 15), 16, 10).cast("long").alias("h")  # the same in any engine
    edges = shared(edges.select(low.alias("a"), high.alias("b")).filter("a <> b").distinct().withColumn("w", F.struct(weight, "a", "b")), "edges")
    open_edges = edges.select("w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    trees = []
    while True:
        ends = open_edges.select(F.col("ca").alias("c"), "*").unionByName(open_edges.select(F.col("cb").alias("c"), "*"))
        picked = shared_path(ends.groupBy("c").agg(F.min(F.struct("w", "ca", "cb")).alias("e")).select("e.*").distinct(), "picked")
        trees.append(picked)
        picked = edges.sparkSession.read.schema(open_edges.schema).parquet(picked)
        if picked.isEmpty():
            return edges.sparkSession.read.schema(open_edges.schema).parquet(*trees).select("w.a", "w.b")
        # Every end of an open edge has picked one. Parts become nodes, and of the edges between two parts only the least can be picked.
        names = shared(components(picked.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "names")
        a, b = (names.select(F.col("node").alias(f"c{n}"), F.col("component").alias(n)) for n in "ab")
        joined = open_edges.join(a, "ca").join(b, "cb").filter("a <> b")
        open_edges = shared(joined.groupBy(F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb")).agg(F.min("w").alias("w")).select("w", "ca", "cb"), "open")


def bounding_box(df: DataFrame, low: tuple, high: tuple, morton_column: str | None = None) -> DataFrame:
    """Rows within [low, high]. A Morton column that is stored, and sorted by, prunes row groups by its range; one that is only
    computed costs more than it saves, so leave it out then."""
    out = df
    for c, a, b in zip(XYZ, low, high, strict=True):
        out = out.filter(F.col(c).between(a, b))
    if morton_column:
        ends = [ids.morton(*[F.lit(v).cast("long") for v in p]) for p in (low, high)]
        out = out.filter(F.col(morton_column).between(*ends))
    return out
