"""Published values, exhaustive regions and small models."""

import heapq
import itertools
import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from vertexloom.functions import ids, lattice, text
from vertexloom.operators import layers, topology
from vertexloom.sources import files
from vertexloom.streaming import fusion

XYZ = ["x", "y", "z"]


def valid(n):
    return [p for p in itertools.product(range(-n, n + 1), repeat=3) if p[0] % 2 == p[1] % 2 == p[2] % 2]


def test_keys(spark):
    lit = F.lit
    n = [lit(v).cast("long") for v in (100, 200, 300)]
    m = [lit(-v).cast("long") for v in (100, 200, 300)]
    key = ids.index64(lit(0), lit(0), lit(5), *n)
    g = ids.galactic128(lit(0), lit(5), lit(1), lit(10), lit(3), *[lit(v).cast("long") for v in (2, 4, 6)])
    row = spark.range(1).select(
        ids.morton(*n).alias("m"), key.alias("i"), ids.hilbert64(lit(0), lit(0), lit(5), *n).alias("h"), ids.route64(lit(0), *n).alias("r"), ids.route64(lit(0), *m).alias("s"),
        text.key_text("i3d1", key).alias("t"), text.bech32m("g3d1", ids.key_bytes(g["hi"], g["lo"])).alias("gt"), ids.route64(lit(0), lit(0), lit(0), lit(1)).alias("bad"),
    ).first()
    assert row.m == 0x44E8D40 and row.i == -9221964661898965696 and row.h == -4610278643436123200
    assert row.r == 4611795969799881004 and row.s == 5764498671174418132 and row.bad is None
    assert row.t == "i3d11sqzsqqqyf6x5qvpj6d3" and row.gt == "g3d11q49qqycqqqqqyqqqqqzqqqqqqcnq3ue3"


def test_text_rejects():
    good = text.encode("i3d1", bytes(range(8)))
    assert text.decode("i3d1", good, 8) == bytes(range(8))
    assert text.decode("r3d1", good, 8) is None and text.decode("i3d1", good, 16) is None
    assert text.decode("i3d1", good[:-1] + ("q" if good[-1] != "q" else "p"), 8) is None


def test_children_partition_the_lattice(spark):
    points = spark.createDataFrame(valid(4), "x long, y long, z long")
    rows = points.select(F.struct(*XYZ).alias("p"), F.explode(lattice.children(*map(F.col, XYZ))).alias("k"))
    back = rows.select("p", "k", F.struct(*[c.alias(n) for c, n in zip(lattice.parent(F.col("k.x"), F.col("k.y"), F.col("k.z")), XYZ, strict=True)]).alias("q"))
    assert back.filter("p <> q").isEmpty() and back.select("k").distinct().count() == back.count()


def test_snap(spark):
    cube = spark.createDataFrame(list(itertools.product(range(-5, 5), repeat=3)), "x long, y long, z long")
    s = cube.select(*XYZ, *[c.alias(f"s{n}") for c, n in zip(lattice.snap(*map(F.col, XYZ)), XYZ, strict=True)]).collect()
    for r in s:
        assert r.sx % 2 == r.sy % 2 == r.sz % 2 and abs(r.sx - r.x) + abs(r.sy - r.y) + abs(r.sz - r.z) <= 1
    bad = spark.createDataFrame([(float("nan"), 0.0, 0.0), (1e300, 0.0, 0.0)], "x double, y double, z double")
    assert bad.select(lattice.physical_to_lattice(*map(F.col, XYZ))[0].alias("c")).filter("c is not null").isEmpty()


def test_rings_and_hops():
    assert [len(lattice.ring_offsets(k)) for k in range(9)] == [1, 15, 65, 175, 369, 671, 1105, 1695, 2465]


def test_paths_with_obstacles(spark):
    free = [p for p in itertools.product(range(6), repeat=3) if p[0] % 2 == p[1] % 2 == p[2] % 2 and p not in ((2, 2, 2), (3, 3, 3), (1, 1, 1))]
    best, heap = {}, [(0.0, (0, 0, 0))]
    while heap:
        d, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = d
        for i, o in enumerate(lattice.NEIGHBORS):
            q = tuple(a + b for a, b in zip(p, o, strict=True))
            if q in free and q not in best:
                heapq.heappush(heap, (d + (3**0.5 if i < 8 else 2.0), q))
    found = topology.shortest_paths(spark.createDataFrame(free, "x long, y long, z long"), spark.createDataFrame([(1, 0, 0, 0)], "id long, x long, y long, z long"))
    found = {(r.x, r.y, r.z): r.cost for r in found.collect()}
    assert found.keys() == best.keys() and all(abs(found[p] - best[p]) < 1e-9 for p in best)


def test_spanning_tree(spark):
    edges = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12) if (a * b) % 3], "a long, b long")
    tree = topology.spanning_tree(edges, 3)
    assert tree.count() == edges.select("a").union(edges.select("b")).distinct().count() - topology.components(edges).select("component").distinct().count()


def test_distance_field(spark):
    layer = spark.createDataFrame([(10, 10, 10, 0.01, 1.0), (14, 10, 10, -0.01, 1.0)], "x long, y long, z long, distance double, w double")
    found = {(r.x, r.y, r.z): r.distance for r in layers.esdf(layer, 0.1, 0.5, 0.05).collect()}
    cost = lambda d: math.sqrt(3) * sorted(map(abs, d))[1] + max(map(abs, d)) - sorted(map(abs, d))[1]
    for p, v in found.items():
        ways = [(0.01 + 0.1 * cost([a - b for a, b in zip(p, s, strict=True)]), sign) for s, sign in (((10, 10, 10), 1), ((14, 10, 10), -1))]
        assert abs(abs(v) - min(0.5, min(w for w, _ in ways))) < 1e-9
    assert found[10, 10, 10] == 0.01 and found[14, 10, 10] == -0.01


def test_occupancy_order_and_clamps(spark):
    rows = [(0, 0, 0, i, i, i < 5, 0.6) for i in range(15)]
    df = spark.createDataFrame(rows, "x long, y long, z long, t long, seq long, occupied boolean, confidence double").withColumn("ts", F.timestamp_seconds(F.col("t") * 50_000))
    assert abs(layers.occupancy(df).first().l + 2.027326) < 1e-6


def test_decay_in_segments(spark):
    rows = [(0, 0, 0, i * i * 3001, i, i % 7 < 4, 0.6 + i % 5 * 0.08) for i in range(60)]
    df = spark.createDataFrame(rows, "x long, y long, z long, t long, seq long, occupied boolean, confidence double").withColumn("ts", F.timestamp_seconds("t"))
    l = t = 0.0
    for *_, at, _, occupied, p in rows:
        l = max(-3.466, min(3.466, l * math.exp(-1e-5 * (at - t)) + (1 if occupied else -1) * math.log(p / (1 - p))))
        t = at
    for segment in ("3600 seconds", "86400 seconds", "100000 days"):
        r = layers.temporal(df, 1e-5, segment=segment).first()
        assert abs(r.l - l) < 1e-9 and r.last == t and r.n == 60


@pytest.mark.parametrize("weights", [[1.0] * 30, [3.0, 0.5, 0.0, 2.0] * 5, [0.0, 9.0, 1.0, 7.0], [0.0, 0.0, 0.0], [9.0], [0.0]])
def test_distances_as_a_fold(spark, weights):
    rows = [(0, 0, 0, (i * 37 % 19 - 9) / 100, w, i) for i, w in enumerate(weights)]
    d = w = 0.0
    for *_, sdf, c, _ in rows:
        new = min(w + c, 5.0)
        d, w = sdf if w == 0 else (d * w + sdf * c) / new, new
    r = layers.tsdf(spark.createDataFrame(rows, "x long, y long, z long, sdf double, weight double, seq long"), max_weight=5.0).first()
    assert abs(r.distance - d) < 1e-9 and r.w == w and r.n == len(rows)


def test_morton_order(spark):
    points = [(a * 7919 % 65536, a * 104729 % 65536, a * 1299709 % 65536) for a in range(300)] + list(itertools.product(range(3), repeat=3))
    df = spark.createDataFrame([(*p, *points[i * 31 % len(points)]) for i, p in enumerate(points)], "x long, y long, z long, a long, b long, c long")
    p, q = tuple(F.col(c) for c in "xyz"), tuple(F.col(c) for c in "abc")
    assert df.filter(lattice.morton_less(p, q) != (ids.morton(*p) < ids.morton(*q))).count() == 0


def test_runs_round_trip(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 2.0, None, None, 3.0])], "k int, i int, v double")
    runs = layers.run_lengths(df, ["k"], "i", "v")
    assert runs.count() == 4 and layers.decode_runs(runs, ["k"], "v").count() == 8


def test_layer_refuses_nan(spark):
    layer = spark.createDataFrame([(0, 0, 0, float("nan")), (2, 2, 2, 10.0)], "x long, y long, z long, value double")
    with pytest.raises(Exception, match="NaN"):
        layers.aggregate(layer, layer).collect()


def test_containers(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(files.container_bytes([b"one", b"", b"three"]))
    assert [r.payload for r in files.read_containers(spark, f"file://{tmp_path}").orderBy("frame").collect()] == [b"one", b"", b"three"]
    data = files.container_bytes([b"one"])
    for bad in (b"x" + data[1:], data[:-1], data[:-1] + b"?", data[:12] + b"\xff\xff\xff\xff" + data[16:]):
        with pytest.raises(ValueError):
            files.container_frames(bad)


def test_data_sets_and_frames(spark, tmp_path):
    layer = spark.createDataFrame([("a", 0, 1, 2, 2, 2, 1.5)], "name string, frame int, resolution int, x int, y int, z int, value double")
    files.write_dataset(layer, f"file://{tmp_path}/d")
    assert files.read_dataset(spark, f"file://{tmp_path}/d").collect() == layer.collect()
    with pytest.raises(ValueError):
        files.frames(spark, [(0, "other", "", 1.0, "WGS84")])
    mesh = (spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vid long, vx double, vy double, vz double"), spark.createDataFrame([(0, 0, 1, 2)], "tid long, a long, b long, c long"))
    assert "f 1 2 3" in [r.line for r in files.mesh_text(*mesh, "obj").collect()]
    assert files.mesh_text(*mesh, "stl").first().line.startswith("facet normal 0.0 0.0 1.0")
    assert files.mesh_text(*mesh, "ply").count() == 5


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3 * 2, 0, 0, 1_000_000 + i * 60, i, i % 2 == 0, 0.6 + i % 4 / 20) for i in range(60)]
    df = spark.createDataFrame(rows, "x long, y long, z long, t long, seq long, occupied boolean, confidence double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    for k in range(3):
        df.filter(F.col("seq").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = fusion.temporal_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 1e-5)
    out = stream.writeStream.outputMode("update").format("memory").queryName("voxels").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination(120)
    found = {(r.x, r.y, r.z): r for r in spark.sql("SELECT * FROM voxels ORDER BY n").collect()}
    for r in layers.temporal(df, 1e-5).collect():
        assert found[r.x, r.y, r.z].n == r.n and abs(found[r.x, r.y, r.z].l - r.l) < 1e-9


def test_strict_keys_and_cells(spark):
    lit, one = F.lit, spark.range(1)
    bad = [ids.index64(lit(0), lit(0), lit(16), *[lit(1).cast("long")] * 3, strict=True)]
    for r, f in ((0, ids.cell_parent), (255, ids.cell_children)):
        c = ids.cell_id(lit(0), lit(r), lit(0), lit(0), *[lit(2).cast("long")] * 3)
        assert one.select(f(c).isNull().alias("n")).first().n
        bad.append(f(c, strict=True))
    bad.append(lattice.checked_point(lit(1).cast("long"), lit(2).cast("long"), lit(3).cast("long"), strict=True))
    for c in bad:
        with pytest.raises(Exception, match="range|parent|children|parity"):
            one.select(c.alias("c")).collect()
    for size in (0, -1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            lattice.Grid(size)


def test_neighbors_at_the_edge(spark):
    row = spark.range(1).select(
        F.size(ids.route_neighbors(ids.route64(F.lit(0), *[F.lit(524286).cast("long")] * 3))).alias("r"), F.size(ids.index_neighbors(ids.index64(F.lit(0), F.lit(0), F.lit(5), *[F.lit(0).cast("long")] * 3))).alias("i")
    ).first()
    assert (row.r, row.i) == (11, 4)


def test_rollup_and_aggregate_raise(spark):
    layer = spark.createDataFrame([(0, 0, 0, float("nan")), (2, 2, 2, 10.0)], "x long, y long, z long, value double")
    with pytest.raises(Exception, match="NaN"):
        layers.rollup(layer).collect()
    assert sum(r["count"] for r in layers.rollup(layer).select("count").collect()) == 2
    with pytest.raises(Exception, match="no cells"):
        layers.aggregate(layer.filter("x > 5"), layer.filter("x > 0")).collect()


def test_median_of_many(spark):
    for n in (1, 2, 7, 10):
        layer = spark.createDataFrame([(2 * i, 0, 0, float(i * 7919 % 101)) for i in range(n)], "x long, y long, z long, value double")
        assert layers.aggregate(layer, layer).first()["median"] == statistics.median(i * 7919 % 101 for i in range(n))


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    assert [r.place for r in topology.numbered(df, ["v"]).orderBy("v").collect()] == list(range(1, 1001))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in topology.components(edges).collect()} == {0}


def test_no_path_and_limits(spark):
    free = spark.createDataFrame([(0, 0, 0), (2, 0, 0), (4, 0, 0), (20, 0, 0)], "x long, y long, z long")
    asked = spark.createDataFrame([(1, 0, 0, 0, 4, 0, 0), (2, 0, 0, 0, 20, 0, 0), (3, 2, 0, 0, 2, 0, 0)], "id long, x long, y long, z long, gx long, gy long, gz long")
    found = {r.id: (r.status, r.cost, r.hops) for r in topology.find_paths(free, asked).collect()}
    assert found == {1: ("ok", 4.0, 2), 2: ("NoPathFound", None, None), 3: ("ok", 0.0, 0)}
    with pytest.raises(RuntimeError, match="limit"):
        topology.find_paths(free, asked, max_steps=1)


def test_measurements(spark):
    rows = spark.createDataFrame([("depth", 2.0), ("occupancy", -1.0)], "kind string, confidence double")
    assert [r.confidence for r in layers.measurements(rows).collect()] == [1.0, 0.0]
    assert layers.dispatch(rows, "occupancy").count() == 1 and layers.dispatch(rows, "esdf").count() == 0
    with pytest.raises(Exception, match="depths only"):
        layers.dispatch(rows, "tsdf").collect()
    with pytest.raises(Exception, match="no such"):
        layers.measurements(rows.withColumn("kind", F.lit("smell"))).collect()
    assert abs(layers.Occupancy.of_probabilities(0.7, 0.3).occupied - 0.8473) < 1e-4


def test_layers_by_name(spark):
    m = layers.LayeredMap()
    layer = spark.createDataFrame([(0, 0, 0, 1.0)], "x long, y long, z long, value double")
    m.add("a", layer)
    with pytest.raises(ValueError):
        m.add("a", layer)
    with pytest.raises(KeyError):
        m.update("b", lambda l: l)
    m.clear()
    assert m.layer_types() == [] and m.total_voxels() == 0


def test_packed_containers_and_collections(spark):
    for codec in ("none", "zstd", "lz4"):
        assert files.container_frames(files.container_bytes([b"one", b"", b"three" * 99], codec)) == [b"one", b"", b"three" * 99]
    features = spark.createDataFrame([(i, json.dumps({"type": "Feature", "id": i})) for i in range(3)], "id long, feature string")
    text = "".join(r.line for r in files.feature_collection(features, "id").orderBy("order").collect())
    assert len(json.loads(text)["features"]) == 3


def test_lines_are_sampled_by_all_tasks(spark):
    """Against plain Python, with nulls and points out of range; lines of one task's rows are dealt out, and many take little time."""
    from decimal import ROUND_HALF_UP, Decimal

    whole = lambda v: int(Decimal(v).quantize(Decimal(1), ROUND_HALF_UP))

    def traced(s, e):
        n = max([abs(b - a) * 2 for a, b in zip(s, e, strict=True) if None not in (a, b)] + [1])
        out = []
        for i in range(n + 1):
            p = [None if None in (a, b) else a + (b - a) * (i / n) for a, b in zip(s, e, strict=True)]
            if any(c is None or abs(c) > 2**31 - 2 for c in p):
                out.append((None,) * 3)
                continue
            even, uneven = [whole(c / 2) * 2 for c in p], [whole((c - 1) / 2) * 2 + 1 for c in p]
            far = lambda q: sum((a - b) * (a - b) for a, b in zip(q, p, strict=True))  # noqa: B023, E731
            out.append(tuple(even if far(even) <= far(uneven) else uneven))
        out.append(tuple(e))
        return [p for k, p in enumerate(out) if k == 0 or p != out[k - 1]]

    ends = [((0, 0, 0), (0, 0, 0)), ((1, 2, 3), (-7, 5, 1)), ((None, 2, 3), (4, 5, 6)), ((1, 2, 3), (None, 5, 6)), ((2**31 - 6, 5, 1), (2**31 + 6, 0, 0)), ((0, 1, 0), (0, 1, 0))]
    ends += [((k % 11 - 5, k % 7, -k), (3 * k, k % 5, 1)) for k in range(60)]
    rows = spark.createDataFrame([(i, *s, *e) for i, (s, e) in enumerate(ends)], "id long, sx long, sy long, sz long, ex long, ey long, ez long").coalesce(1)
    start, end = ([F.col(f"{k}{c}") for c in XYZ] for k in "se")
    lines = topology.trace_lines(rows, start, end)
    assert lines.columns == [*rows.columns, "line"] and lines.rdd.getNumPartitions() > 1
    assert {r.id: [tuple(p) for p in r.line] for r in lines.collect()} == {i: traced(*e) for i, e in enumerate(ends)}
    far = [topology.SAMPLES // 2, 0, 1, 5]  # a line longer than what is held at once, and those after it
    many = spark.createDataFrame([(x, 0, 0) for x in far], "sx long, sy long, sz long").coalesce(1)
    long = topology.trace_lines(many, start, [F.lit(0).cast("long")] * 3).collect()
    assert {r.sx: [tuple(p) for p in r.line] for r in long} == {x: traced((x, 0, 0), (0, 0, 0)) for x in far}


def test_containers_of_many_frames(spark):
    """More than one container may hold by its format, whatever is asked for; frames keep their numbers, of cut containers and after gaps too."""
    n = files.FRAMES_MOST + 5
    seq = F.col("id") + F.when(F.col("id") >= 70_000, 3).otherwise(0)
    frames = spark.range(0, n, 1, 1).select(F.lit("a").alias("container"), seq.alias("seq"), F.encode(seq.cast("string"), "UTF-8").alias("payload"))
    for most in (1 << 40, 1000):
        data = files.containers(frames, "none", most)
        found = files.frames_of(data.select(F.col("container").alias("path"), "first", "data"))
        at = F.decode("payload", "UTF-8").cast("long")
        r = found.agg(F.count("*").alias("n"), F.count_distinct("frame").alias("d"), F.count_if((F.col("path") == "a") & (F.col("frame") == at)).alias("same")).first()
        assert (r.n, r.d, r.same) == (n, n, n)
        held = [len(files.container_frames(bytes(r.data))) for r in data.collect()]
        assert sum(held) == n and max(held) == min(most, 70_000)
    with pytest.raises(ValueError):
        files.container_bytes([b""] * n)


def test_neighbors_of_keys_are_generated_code(spark):
    """Against plain Python at the edges of the ranges; lambdas would run uncompiled for each neighbour."""
    def near(p, low, high):
        found = [tuple(a + b for a, b in zip(p, n, strict=True)) for n in lattice.NEIGHBORS]
        return [q for q in found if all(low <= c <= high for c in q)]

    kinds = {
        "index": (0, 65535, lambda c: ids.index64(F.lit(3), F.lit(1), F.lit(4), *c), ids.index_neighbors),
        "route": (-(1 << 19), (1 << 19) - 1, lambda c: ids.route64(F.lit(2), *c), ids.route_neighbors),
        "galactic": (-(1 << 31), (1 << 31) - 1, lambda c: ids.galactic128(F.lit(2), F.lit(5), F.lit(1), F.lit(10), F.lit(3), *c), ids.galactic_neighbors),
    }
    for low, high, make, around in kinds.values():
        ends = [low, low + 1, low + 2, (low + high) // 2, high - 2, high - 1, high]
        points = [p for p in itertools.product(ends, repeat=3) if p[0] % 2 == p[1] % 2 == p[2] % 2]
        every = sorted({q for p in points for q in [p, *near(p, low, high)]})
        made = spark.createDataFrame(every, "x long, y long, z long").select(*XYZ, make([F.col(c) for c in XYZ]).alias("k"))
        keys = {tuple(r)[:3]: r.k for r in made.collect()}
        found = made.select(*XYZ, around(F.col("k")).alias("n"))
        assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
        held = {tuple(r)[:3]: r.n for r in found.collect()}
        for p in points:
            assert held[p] == [keys[q] for q in near(p, low, high)]
        none = made.limit(1).select(around(F.when(F.col("x") > high, F.col("k"))).alias("n"))
        assert none.first().n == []
