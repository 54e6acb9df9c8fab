"""Queries on layers, meshes, files and streams beyond those in the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import layers
from ..operators.topology import XYZ, shared
from ..sources import binary, files, tables
from ..streaming import fusion
from .catalogue import (
    _BFOLD, _EDGES, _ESDF, _FOLD, _LOGIT, _NEIGHBORS, _PARENT, _T, _TFOLD, CELLS, OBS, POINTS, SIGNED, _morton, _occupancy, _snap, _tsdf, col, query, r6,
)

# Layers. --------------------------------------------------------------------------------------------------------------

_END = "(SELECT max(epoch_us(ts) / 1000000.0::DOUBLE) AS e FROM events)"
_NOW = "s.l * exp(-0.00001 * (b.e - s.t))"


def _end(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("e"))


def _aged(spark, sf_dir):
    """The decaying layer with the time of the last event as e."""
    return layers.temporal(tables.observations(spark, sf_dir), 1e-5).crossJoin(F.broadcast(_end(spark, sf_dir)))  # one row


@query(f"SELECT count(*)::BIGINT AS total, count_if({_NOW} > 0.847)::BIGINT AS occupied, count_if({_NOW} < -1.099)::BIGINT AS free, count_if({_NOW} BETWEEN -1.099 AND 0.847)::BIGINT AS unknown, 0::BIGINT AS dynamic, count_if(b.e - s.t > 86400)::BIGINT AS stale FROM ({_TFOLD}), {_END} b")
def temporal_totals(spark, sf_dir):
    return layers.temporal_stats(_aged(spark, sf_dir), F.col("e"), 1e-5, 86400.0)


@query(f"SELECT x, y, z, n, round(1 / (1 + exp(-{_NOW})), 6) AS p FROM ({_TFOLD}), {_END} b WHERE b.e - s.t < 86400")
def fresh_voxels(spark, sf_dir):
    """Voxels that aren't stale, with their probability now."""
    kept = layers.prune_stale(_aged(spark, sf_dir), F.col("e"), 86400.0)
    return layers.temporal_state(kept, F.col("e"), 1e-5, 86400.0).select(*XYZ, "n", r6(F.col("p"), "p"))


@query(
    "WITH r AS (SELECT id AS ray, floor(2.3 / 0.5)::BIGINT AS a, floor((x + 8) / 0.5)::BIGINT AS bx, floor((y + 8) / 0.5)::BIGINT AS by_, floor((z + 8) / 0.5)::BIGINT AS bz FROM (" + POINTS + ")), "
    "n AS (SELECT *, least(greatest(abs(bx - a), abs(by_ - a), abs(bz - a)), 1000) AS n FROM r), s AS (SELECT *, unnest(range(n + 1)) AS step FROM n), "
    "c AS (SELECT ray, step, step = n AS occupied, " + ", ".join(f"CASE WHEN step < n THEN round(a + step / n * ({b} - a))::BIGINT ELSE {b} END AS {c}" for c, b in zip(XYZ, ("bx", "by_", "bz"), strict=True)) + " FROM s) "
    "SELECT x, y, z, count(*)::BIGINT AS n, count_if(occupied)::BIGINT AS hits, sum(step)::BIGINT AS steps FROM c WHERE x BETWEEN 0 AND 65535 AND y BETWEEN 0 AND 65535 AND z BETWEEN 0 AND 65535 GROUP BY 1, 2, 3"
)
def temporal_ray_hits(spark, sf_dir):
    p = tables.points(spark, sf_dir)
    r = p.select(F.col("id").alias("ray"), *[F.lit(2.3).alias(f"s{c}") for c in XYZ], *[(F.col(c) + 8.0).alias(f"e{c}") for c in XYZ])
    return layers.temporal_rays(r, 0.5, 0.7, 0.9).groupBy(*XYZ).agg(F.count("*").alias("n"), F.count_if("occupied").alias("hits"), F.sum("step").alias("steps"))


_DENSE = f"SELECT bx, by_, bz, list_transform(range(512), lambda i: coalesce(round(m[i][1], 6), 0.0::DOUBLE)) AS v FROM (SELECT x // 8 AS bx, y // 8 AS by_, z // 8 AS bz, map_from_entries(list((((x % 8) + (y % 8) * 8 + (z % 8) * 64)::BIGINT, l))) AS m FROM ({_BFOLD}) GROUP BY 1, 2, 3)"
_DENSE = _DENSE.replace("m[i][1]", "m[i]")


def _blocks(spark, sf_dir):
    held = layers.block_occupancy(tables.observations(spark, sf_dir))
    return held.withColumn("values", F.transform("values", lambda v: F.round(v, 6)))


@query(f"WITH d AS ({_DENSE}), t AS (SELECT (1 + len(list_filter(range(2, 513), lambda i: v[i] <> v[i - 1]))) * 8 AS packed FROM d) SELECT count(*)::BIGINT AS blocks, sum(packed)::BIGINT AS packed, (count(*) * 2048)::BIGINT AS full_, round(count(*) * 2048 / sum(packed), 6) AS ratio, round((count(*) * 2048 - sum(packed)) / 1048576, 6) AS saved_mb FROM t")
def block_compression(spark, sf_dir):
    s = layers.compression_stats(_blocks(spark, sf_dir))
    return s.select("blocks", "packed", F.col("full").alias("full_"), r6(F.col("ratio"), "ratio"), r6(F.col("saved_mb"), "saved_mb"))


@query(f"SELECT bx, by_, bz, round(list_sum(v), 4) AS total, count_l AS cells, true AS same FROM ({_DENSE}) JOIN (SELECT x // 8 AS bx, y // 8 AS by_, z // 8 AS bz, count(*)::BIGINT AS count_l FROM ({_BFOLD}) GROUP BY 1, 2, 3) USING (bx, by_, bz)")
def block_codecs(spark, sf_dir):
    """Blocks through runs, and through each codec of bytes, are the same again."""
    held = shared(_blocks(spark, sf_dir), "blocks")
    back = layers.unrun_blocks(layers.block_runs(held)).select("bx", "by", "bz", F.col("values").alias("runs"))
    out = held.join(back, ["bx", "by", "bz"])
    same = F.col("values") == F.col("runs")
    for codec in ("none", "lz4", "zstd"):
        out = out.join(binary.blocks_of_bytes(binary.block_bytes(held, codec), codec).withColumnRenamed("values", codec), ["bx", "by", "bz"])
        same = same & F.forall(F.arrays_zip("values", codec), lambda p: F.abs(p["values"] - p[codec]) < 1e-5)  # noqa: B023
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return out.select("bx", F.col("by").alias("by_"), "bz", F.round(total, 4).alias("total"), F.col("n").alias("cells"), same.alias("same"))


_STATE_B = "CASE WHEN l > 0.847 THEN 'Occupied' WHEN l < -1.099 THEN 'Free' ELSE 'Unknown' END"


@query(f"SELECT x, y, z, round(l, 6) AS l, {_STATE_B} AS state FROM ({_BFOLD}) WHERE abs(l - 0.847) > 0.0001 AND abs(l + 1.099) > 0.0001")
def block_states(spark, sf_dir):
    """Voxels of the layer in blocks by its thresholds; logits that fall on one (to 4 places) are left out, since the last bit would decide."""
    layer = layers.occupancy(tables.observations(spark, sf_dir), layers.BLOCKS)
    l = F.col("l")
    return layer.filter((F.abs(l - 0.847) > 1e-4) & (F.abs(l + 1.099) > 1e-4)).select(*XYZ, r6(l, "l"), layers.block_state(l).alias("state"))


_MEASURED = f"SELECT x, y, z, seq, ts, occupied, CASE seq % 4 WHEN 0 THEN 'depth' WHEN 1 THEN 'color' ELSE 'occupancy' END AS kind, greatest(0.0, least(1.0, confidence * 2 - 0.6)) AS confidence FROM ({OBS})"


def _measured(spark, sf_dir):
    kind = F.when(F.col("seq") % 4 == 0, "depth").when(F.col("seq") % 4 == 1, "color").otherwise("occupancy")
    rows = tables.observations(spark, sf_dir).withColumn("kind", kind).withColumn("confidence", F.col("confidence") * 2 - 0.6)
    return layers.measurements(rows)


@query(f"SELECT x, y, z, round(list_reduce(list(CASE WHEN occupied THEN {_LOGIT} ELSE -{_LOGIT} END ORDER BY ts, seq), lambda a, d: greatest(-3.5, least(3.5, a + d)), 0.0::DOUBLE), 5) AS l, count(*)::BIGINT AS n FROM ({_MEASURED}) WHERE kind = 'occupancy' GROUP BY x, y, z")
def measured_occupancy(spark, sf_dir):
    """An occupancy layer takes the measurements of its kind from a mixed stream; confidences stay within 0 and 1."""
    out = layers.occupancy(layers.dispatch(_measured(spark, sf_dir), "occupancy"))
    return out.select(*XYZ, F.round("l", 5).alias("l"), "n")


@query(f"WITH l AS (SELECT x, y, z, sum(value) AS value FROM ({CELLS}) GROUP BY x, y, z), kept AS (SELECT * FROM l WHERE NOT (x < 8 AND y < 8)) SELECT w.x, w.y, w.z, round(value, 4) AS value, value IS NOT NULL AS there FROM (SELECT DISTINCT x, y, z FROM ({CELLS}) WHERE z < 16) w LEFT JOIN kept k ON k.x = w.x AND k.y = w.y AND k.z = w.z")
def layer_edits(spark, sf_dir):
    """A layer after some of its cells are removed, asked at others."""
    cells = tables.cells(spark, sf_dir)
    layer = layers.remove(cells.groupBy(*XYZ).agg(F.sum("value").alias("value")), cells.filter("x < 8 and y < 8"))
    found = layers.get(layer, cells.filter("z < 16").select(*XYZ).distinct())
    return found.select(*XYZ, F.round("value", 4).alias("value"), "there")


@query(f"SELECT px AS x, py AS y, pz AS z, resolution - 1 AS resolution, count(*)::BIGINT AS count, round(sum(value), 4) AS sum FROM (SELECT value, resolution, {_PARENT} FROM (SELECT *, (x + y) % 4 AS resolution FROM ({CELLS}))) WHERE resolution > 0 GROUP BY 1, 2, 3, 4")
def rollup_graded(spark, sf_dir):
    """A roll-up of cells with resolutions: those of resolution 0 drop out."""
    rows = tables.cells(spark, sf_dir).withColumn("resolution", (F.col("x") + F.col("y")) % 4)
    return layers.rollup(rows).select(*XYZ, "resolution", "count", F.round("sum", 4).alias("sum"))


@query(f"SELECT x, y, z, round(distance, 6) AS distance, distance > 0.1 AS open_ FROM ({_ESDF}) WHERE abs(distance) <= 0.2")
def near_surface(spark, sf_dir):
    """Voxels of the distance field near the surface, and whether they are free space."""
    field = layers.esdf(_tsdf(spark, sf_dir), 0.05, 0.3, 0.005)
    near = layers.within_distance(field, 0.2)
    return near.select(*XYZ, r6(F.col("distance"), "distance"), layers.is_free_space(F.col("distance"), 0.1).alias("open_"))


@query(
    f"WITH t AS ({_T}), g AS (SELECT p.x, p.y, p.z, " + ", ".join(f"avg((q.d - p.d) * {o} * 0.02) AS g{c}" for o, c in zip("abc", XYZ, strict=True)) + f" FROM t p, {_NEIGHBORS}, t q WHERE q.x = p.x + a AND q.y = p.y + b AND q.z = p.z + c GROUP BY 1, 2, 3), "
    "m AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS m FROM g) "
    f"SELECT e.x, e.y, e.z, e.nx, e.ny, e.nz, row_number() OVER (ORDER BY e.x, e.y, e.z, e.nx, e.ny, e.nz) - 1 AS vid, round(gx / m, 4) AS gx, round(gy / m, 4) AS gy, round(gz / m, 4) AS gz FROM ({_EDGES}) e LEFT JOIN (SELECT * FROM m WHERE m > 0.000001) m USING (x, y, z)"
)
def mesh_normals(spark, sf_dir):
    """Vertices with their numbers and normals."""
    layer = shared(_tsdf(spark, sf_dir), "tsdf")
    v = layers.with_normals(layers.mesh_vertices(layer, 0.02), layer, 0.02)
    v, _ = layers.numbered_mesh(v, spark.createDataFrame([], "a struct<x:bigint,y:bigint,z:bigint,nx:bigint,ny:bigint,nz:bigint>, b struct<x:bigint,y:bigint,z:bigint,nx:bigint,ny:bigint,nz:bigint>, c struct<x:bigint,y:bigint,z:bigint,nx:bigint,ny:bigint,nz:bigint>"))
    return v.select(*XYZ, "nx", "ny", "nz", "vid", *[F.round(f"g{c}", 4).alias(f"g{c}") for c in XYZ])


_MESH = (
    f"v AS (SELECT {{'x': x, 'y': y, 'z': z, 'nx': nx, 'ny': ny, 'nz': nz}} AS e, row_number() OVER (ORDER BY x, y, z, nx, ny, nz) - 1 AS vid, (x + t * (nx - x)) * 0.02 AS vx, (y + t * (ny - y)) * 0.02 AS vy, (z + t * (nz - z)) * 0.02 AS vz FROM ({_EDGES})), "
    "ends AS (SELECT e.x AS x, e.y AS y, e.z AS z, vid FROM v UNION ALL SELECT e.nx, e.ny, e.nz, vid FROM v), "
    "f AS (SELECT DISTINCT a.vid AS a, b.vid AS b, c.vid AS c FROM ends a JOIN ends b USING (x, y, z) JOIN ends c USING (x, y, z) WHERE a.vid < b.vid AND b.vid < c.vid)"
)


def _mesh(spark, sf_dir):
    v = shared(layers.mesh_vertices(_tsdf(spark, sf_dir), 0.02), "vertices")
    return v, shared(layers.mesh_triangles(v), "triangles")


@query(f"WITH {_MESH} SELECT (SELECT count(*) FROM v)::BIGINT AS vertices, (SELECT count(*) FROM f)::BIGINT AS triangles, " + ", ".join(f"(SELECT round({n}(v{c}), 6) FROM v) AS {e}_{c}" for e, n in (("low", "min"), ("high", "max")) for c in XYZ))
def mesh_totals(spark, sf_dir):
    s = layers.mesh_stats(*_mesh(spark, sf_dir))
    return s.select("vertices", "triangles", *[r6(F.col(f"{e}_{c}"), f"{e}_{c}") for e in ("low", "high") for c in XYZ])


@query(f"WITH {_MESH} SELECT 'v' AS kind, count(*)::BIGINT AS n, sum(vid)::BIGINT AS ids, round(sum(vx + 2 * vy + 3 * vz), 3) AS total FROM v UNION ALL SELECT 'f', count(*), sum((a + 1) + 2 * (b + 1) + 3 * (c + 1))::BIGINT, 0 FROM f")
def mesh_file(spark, sf_dir):
    """An OBJ file's lines, read again."""
    v, t = layers.numbered_mesh(*_mesh(spark, sf_dir))
    lines = files.mesh_text(v, t, "obj").select("order.n", F.split("line", " ").alias("w"))
    w = [F.col("w")[i] for i in range(4)]
    num = [c.cast("double") for c in w[1:]]
    face = w[0] == "f"
    ids_ = F.when(face, num[0] + 2 * num[1] + 3 * num[2]).otherwise(F.col("n"))
    total = F.when(face, 0.0).otherwise(num[0] + 2 * num[1] + 3 * num[2])
    return lines.groupBy(w[0].alias("kind")).agg(F.count("*").alias("n"), F.sum(ids_).cast("long").alias("ids"), F.round(F.sum(total), 3).alias("total"))


_DEPTHS = "SELECT *, (l_discount - 0.05) * 2 + sqrt(power(x * 0.02 - 0.3, 2) + power(y * 0.02 - 0.3, 2) + power(z * 0.02 - 0.3, 2)) AS depth FROM (" + _snap("l_partkey % 32", "l_suppkey % 32", "(l_orderkey + l_linenumber) % 32", "lineitem", "l_discount AS l_discount ; l_orderkey * 8 + l_linenumber AS seq") + ")"


@query(f"SELECT x, y, z, round(sum(depth - sqrt(power(x * 0.02 - 0.3, 2) + power(y * 0.02 - 0.3, 2) + power(z * 0.02 - 0.3, 2))) / count(*), 5) AS distance, count(*)::DOUBLE AS w FROM ({_DEPTHS}) GROUP BY x, y, z")
def depth_layer(spark, sf_dir):
    """Distances from depths along rays of a sensor; the weights stay below their cap here or divide as it says."""
    rows = tables.distances(spark, sf_dir).select(*XYZ, F.col("sdf"), "weight", "seq", *[F.lit(0.3).alias(f"s{c}") for c in XYZ])
    far = F.sqrt(sum(((F.col(c) * 0.02 - 0.3) * (F.col(c) * 0.02 - 0.3) for c in XYZ), F.lit(0.0)))
    rows = layers.depth_rays(rows.withColumn("depth", F.col("sdf") + far).drop("sdf"), 0.02)
    return layers.tsdf(rows, truncation=0.11, max_weight=1e9).select(*XYZ, F.round("distance", 5).alias("distance"), "w")


@query(f"WITH r AS ({_snap('l_partkey % 32', 'l_suppkey % 32', '(l_orderkey + l_linenumber) % 32', 'lineitem', '(l_discount - 0.05) * 2 AS sdf ; l_linenumber % 3 AS w')}), k AS (SELECT x, y, z, sum(sdf * w) AS dw, sum(w) AS all_ FROM r WHERE abs(sdf) <= 0.1 GROUP BY x, y, z) SELECT x, y, z, round(dw / least(all_, 3), 5) AS distance, least(all_, 3)::DOUBLE AS w FROM k WHERE all_ > 0")
def capped_layer(spark, sf_dir):
    """Distances with weights 0, 1 and 2, capped at 3; cells without any weight are left out, since only the order decides there."""
    rows = tables.distances(spark, sf_dir).withColumn("weight", (F.col("seq") % 8 % 3).cast("double"))
    return layers.tsdf(rows, max_weight=3.0).filter("w > 0").select(*XYZ, F.round("distance", 5).alias("distance"), "w")


@query(f"WITH o AS (SELECT x, y, z FROM ({_FOLD})), t AS ({_T}) SELECT (SELECT count(*) FROM o)::BIGINT + (SELECT count(*) FROM t)::BIGINT AS voxels, 40 * ((SELECT count(*) FROM o)::BIGINT + (SELECT count(*) FROM t)::BIGINT) AS bytes, 'occupancy,tsdf' AS kinds")
def map_totals(spark, sf_dir):
    m = layers.LayeredMap()
    m.add("tsdf", _tsdf(spark, sf_dir))
    m.add("occupancy", _occupancy(spark, sf_dir))
    m.add("esdf", _tsdf(spark, sf_dir).limit(0))
    m.update("esdf", lambda layer: layers.within_distance(layer, 1.0))
    m.remove("esdf")
    return spark.createDataFrame([(m.total_voxels(), m.memory_bytes(), ",".join(m.layer_types()))], "voxels long, bytes long, kinds string")


@query()
def view_scores(spark, sf_dir):
    """Poses around the clusters by what they would see."""
    layer = shared(_occupancy(spark, sf_dir), "layer")
    views = shared(layers.viewpoints(shared(layers.frontiers(layer), "clusters")), "views")
    return layers.information_gain(views, layer).orderBy(F.desc("gain"), "view")


# Files. ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT x * 0.05::DOUBLE AS x, y * 0.05::DOUBLE AS y, z * 0.05::DOUBLE AS z, round(1 / (1 + exp(-l)), 5) AS intensity FROM ({_FOLD}) WHERE l > 0.85".replace("x * 0.05::DOUBLE AS x", "round(x * 0.05::DOUBLE, 4) AS x").replace("y * 0.05::DOUBLE AS y", "round(y * 0.05::DOUBLE, 4) AS y").replace("z * 0.05::DOUBLE AS z", "round(z * 0.05::DOUBLE, 4) AS z"))
def point_cloud(spark, sf_dir):
    """Occupied voxels as a cloud's bytes with intensity, read again."""
    held = _occupancy(spark, sf_dir).filter("l > 0.85")
    cloud = files.read_point_cloud(files.point_cloud(held, 0.05, layers.probability(F.col("l"))))
    return cloud.select(*[F.round(c, 4).alias(c) for c in XYZ], F.round("intensity", 5).alias("intensity"))


@query(f"SELECT id, 'Point' AS kind, round(round(x / 111320.0 * 1000000) / 1000000, 6) AS lon, round(round(y / 110540.0 * 1000000) / 1000000, 6) AS lat, z::DOUBLE AS alt FROM ({SIGNED}) WHERE id % 7 <> 3")
def geojson_points(spark, sf_dir):
    """Features of cells, read again; cells of a frame that isn't known drop out."""
    rows = tables.signed_cells(spark, sf_dir).withColumn("frame", F.when(F.col("id") % 7 == 3, 200).otherwise(0))
    out = files.geojson_points(rows, files.frames(spark))
    f = F.from_json("feature", "geometry struct<type:string,coordinates:array<double>>")
    at = f["geometry"]["coordinates"]
    return out.select("id", f["geometry"]["type"].alias("kind"), r6(at[0], "lon"), r6(at[1], "lat"), at[2].alias("alt"))


@query(f"SELECT id % 5 AS k, 'LineString' AS kind, count(*)::INT AS n, list(round(x * 2.5, 6) ORDER BY id) AS lon, list(z * 2.5::DOUBLE ORDER BY id) AS alt FROM ({SIGNED}) GROUP BY 1, 2")
def geojson_lines(spark, sf_dir):
    """Lines through cells in order, in a frame with a unit of its own."""
    rows = tables.signed_cells(spark, sf_dir).select((F.col("id") % 5).alias("k"), "id", *XYZ, F.lit(7).alias("frame"))
    out = files.geojson_line(rows, files.frames(spark, [(7, "hall", "a hall", 2.5, "local")]), ["k"], "id")
    f = F.from_json("feature", "geometry struct<type:string,coordinates:array<array<double>>>, properties struct<count:int>")
    at = f["geometry"]["coordinates"]
    return out.select("k", f["geometry"]["type"].alias("kind"), f["properties"]["count"].alias("n"), F.transform(at, lambda p: F.round(p[0], 6)).alias("lon"), F.transform(at, lambda p: p[2]).alias("alt"))


@query(f"SELECT x, y, z, 3 AS frame, 4 AS resolution, 'Feature' AS kind, true AS same FROM ({SIGNED})")
def geojson_cells(spark, sf_dir):
    """Features of 128-bit cells, read again; their texts decode to the cells."""
    from ..functions import text

    rows = tables.signed_cells(spark, sf_dir).select(ids.cell_id(F.lit(3), F.lit(4), F.lit(0), F.lit(0), *col(*XYZ)).alias("c"))
    out = files.cells_geojson(rows)
    f = F.from_json("feature", "type string, geometry struct<coordinates:array<double>>, properties struct<cell_id:string,frame:int,resolution:int>")
    at, props = f["geometry"]["coordinates"], f["properties"]
    out = out.select(*[at[i].cast("long").alias(c) for i, c in enumerate(XYZ)], props["frame"].alias("frame"), props["resolution"].alias("resolution"), f["type"].alias("kind"), props["cell_id"].alias("t"))
    made = ids.cell_id(F.lit(3), F.lit(4), F.lit(0), F.lit(0), *col(*XYZ))
    same = F.hex(text.bech32m_decode(text.PREFIXES["cell"], F.col("t"), 16)) == F.hex(ids.key_bytes(made["hi"], made["lo"]))
    return out.select(*XYZ, "frame", "resolution", "kind", same.alias("same"))


_SET = f"SELECT 'set' || (id % 3) AS name, 0 AS frame, 5 AS resolution, x::INT AS x, y::INT AS y, z::INT AS z, id / 8 AS value FROM ({SIGNED})"


def _set(spark, sf_dir):
    rows = tables.signed_cells(spark, sf_dir)
    return rows.select(F.concat(F.lit("set"), F.col("id") % 3).alias("name"), F.lit(0).alias("frame"), F.lit(5).alias("resolution"), *[F.col(c).cast("int").alias(c) for c in XYZ], (F.col("id") / 8).alias("value"))


@query(_SET)
def cbor_sets(spark, sf_dir):
    """Data sets as CBOR, read again."""
    return binary.datasets_of(binary.cbor_datasets(_set(spark, sf_dir)))


@query(_SET)
def json_sets(spark, sf_dir):
    """Data sets as JSON files in the shared folder, read again."""
    from uuid import uuid4

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        return shared(_set(spark, sf_dir), "sets")
    path = f"{folder.rstrip('/')}/sets-{uuid4().hex}"
    files.write_dataset(_set(spark, sf_dir), path)
    return files.read_dataset(spark, path)


def _frames(spark, sf_dir):
    """Frames numbered from 0 in each of four containers."""
    rows = tables.signed_cells(spark, sf_dir)
    text = F.concat_ws(" ", "id", *XYZ)
    return rows.select((F.col("id") % 4).alias("container"), F.floor(F.col("id") / 4).cast("long").alias("seq"), F.encode(F.repeat(text, 5), "UTF-8").alias("payload"))


_FRAMES = f"SELECT (id % 4)::VARCHAR AS path, id // 4 AS frame, repeat(id || ' ' || x || ' ' || y || ' ' || z, 5) AS text FROM ({SIGNED})"


@query(_FRAMES)
def containers(spark, sf_dir):
    """Frames in packed containers of format 1, a thousand in each, read again."""
    data = files.containers(_frames(spark, sf_dir), "zstd").select(F.col("container").alias("path"), "first", "data")
    return files.frames_of(data).select("path", "frame", F.decode("payload", "UTF-8").alias("text"))


@query(_FRAMES)
def stream_containers(spark, sf_dir):
    """The same in containers of format 2, with hashes."""
    data = binary.stream_containers(_frames(spark, sf_dir), "lz4", True).select(F.col("container").alias("path"), "first", "data")
    return binary.stream_frames_of(data).select("path", "frame", F.decode("payload", "UTF-8").alias("text"))


# Streams. -------------------------------------------------------------------------------------------------------------


def _observed(spark, sf_dir):
    return tables.observations(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(spark: SparkSession, rows: DataFrame, make, mode: str, label: str) -> DataFrame:
    """What a stream over the rows, stored first, leaves behind: all rows of its last state or of all its changes."""
    from uuid import uuid4

    at = shared(rows, label)
    source = spark.readStream.schema(at.schema).parquet(at.inputFiles()[0].rsplit("/", 1)[0])
    base = at.inputFiles()[0].rsplit("/", 2)[0]
    folder = f"{base}/{label}-{uuid4().hex}"
    sink = lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")
    running = make(source).writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(f"SELECT x, y, z, n, round(s.l, 6) AS l, round(s.t, 3) AS last FROM ({_TFOLD})")
def temporal_stream(spark, sf_dir):
    """The decaying layer, kept by a stream."""
    changes = _streamed(spark, _observed(spark, sf_dir), lambda s: fusion.temporal_stream(s, 1e-5, late="1000 days"), "update", "voxel-stream")
    last = changes.groupBy(*XYZ).agg(F.max_by(F.struct("l", "last", "n"), "batch").alias("s"))
    return last.select(*XYZ, F.col("s.n").alias("n"), r6(F.col("s.l"), "l"), F.round("s.last", 3).alias("last"))


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS hour, x, y, z, count(*)::BIGINT AS n FROM ({OBS}) GROUP BY ALL")
def density_stream(spark, sf_dir):
    """Counts by voxel and hour, kept by a stream."""
    out = _streamed(spark, _observed(spark, sf_dir), lambda s: fusion.density_stream(s, late="1000 days"), "complete", "density-stream")
    last = out.agg(F.max("batch").alias("b"))
    return out.join(F.broadcast(last), F.col("batch") == F.col("b")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), *XYZ, "n")


@query(f"SELECT DISTINCT x + a AS nx, y + b AS ny, z + c AS nz FROM ({OBS}), {_NEIGHBORS} WHERE x + a BETWEEN 0 AND 65535 AND y + b BETWEEN 0 AND 65535 AND z + c BETWEEN 0 AND 65535")
def neighbor_stream(spark, sf_dir):
    """Neighbours of a stream's cells, as they come."""
    from ..operators.topology import explode_neighbors

    out = _streamed(spark, tables.observations(spark, sf_dir).select(*XYZ), lambda s: explode_neighbors(s, 0, 65535), "append", "neighbor-stream")
    return out.select("nx", "ny", "nz").distinct()
