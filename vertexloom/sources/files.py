"""File formats: frames of reference, data sets, GeoJSON, meshes, point clouds, grids and framed containers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import python_rows, shipped

XYZ = ["x", "y", "z"]
DATASET = "name string, cells array<struct<frame:int,resolution:int,x:int,y:int,z:int,value:double>>"
#: Cells of a data set, about; larger sets are several of the same name, as a set is held whole where it is made and read.
CELLS = 10_000
#: Container format 1, fixed values: magic, and the limits that a reader trusts (frames; a frame's bytes, packed and unpacked).
MAGIC, FRAMES_MOST, PACKED_MOST, UNPACKED_MOST = b"OCTA3D\0\0", 100_000, 64 << 20, 256 << 20
CODECS = {"lz4": 0, "zstd": 1, "none": 3}
FRAME, FRAME_NAMES = "path string, frame long, payload binary", ["path", "frame", "payload"]


def frames(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """Frames of reference; a frame told twice must be the same, whatever its description says."""
    known: dict[int, tuple] = {}
    for row in [(0, "ECEF", "Earth-centred, earth-fixed", 1.0, "WGS84"), *more]:
        old = known.get(row[0])
        if old is not None and (old[1], *old[3:]) != (row[1], *row[3:]):
            raise ValueError(f"frame {row[0]} is another one already")
        known.setdefault(row[0], row)
    return spark.createDataFrame(list(known.values()), "id int, name string, description string, base_unit double, datum string")


def to_geographic(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """lon, lat, alt: scaled linearly in the earth's frame, else in the frame's units. Unknown frames drop out."""
    f = frames.select(F.col("id").alias("frame"), "name", "base_unit")  # at most 256 frames
    out = cells.join(F.broadcast(f), "frame")
    earth = F.col("name") == "ECEF"
    pick = lambda c, by: F.when(earth, F.col(c) / by).otherwise(F.col(c) * F.col("base_unit"))
    return out.select(*cells.columns, pick("x", 111320.0).alias("lon"), pick("y", 110540.0).alias("lat"), pick("z", 1.0).alias("alt"))


def geojson_points(cells: DataFrame, frames: DataFrame, places: int = 6) -> DataFrame:
    """A feature a row; FeatureCollections are these between a head and a tail."""
    g = to_geographic(cells, frames)
    at = F.array(*[F.round(F.col(c) * 10.0**places) / 10.0**places for c in ("lon", "lat", "alt")])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"), F.struct("id").alias("properties"))
    return g.select("id", F.to_json(feature).alias("feature"))


def geojson_line(cells: DataFrame, frames: DataFrame, keys: list[str], order: str, polygon: bool = False) -> DataFrame:
    """A LineString (or Polygon of one ring) for each key, through its cells in order."""
    g = to_geographic(cells, frames).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.array("lon", "lat", "alt").alias("at")))).alias("p"))
    ring = F.transform("p", lambda p: p["at"])
    shape = F.array(ring) if polygon else ring
    geometry = F.struct(F.lit("Polygon" if polygon else "LineString").alias("type"), shape.alias("coordinates"))
    return g.select(*keys, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.size("p").alias("count")).alias("properties"))).alias("feature"))


def cells_geojson(cells: DataFrame) -> DataFrame:
    """cells (c: a 128-bit cell) to cell_id and feature: points in lattice units with the cell's checksummed text."""
    from ..functions import ids, text

    f = ids.cell_fields(F.col("c"))
    shown = text.bech32m(text.PREFIXES["cell"], ids.key_bytes(F.col("c.hi"), F.col("c.lo")))
    rows = cells.select(shown.alias("cell_id"), *[f[n].alias(n) for n in ("frame", "resolution", *XYZ)])
    at = F.array(*[F.col(c).cast("double") for c in XYZ])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"), F.struct("cell_id", "frame", "resolution").alias("properties"))
    return rows.select("cell_id", F.to_json(feature).alias("feature"))


def feature_collection(features: DataFrame, order: str) -> DataFrame:
    """Lines (order, line) of a FeatureCollection of features (order, feature); no task has them all."""
    place = F.struct(F.lit(1).alias("part"), F.col(order).cast("string").alias("n")).alias("order")
    first = features.agg(F.min(F.col(order).cast("string")).alias("first"))
    body = features.crossJoin(F.broadcast(first)).select(place, F.concat(F.when(F.col(order).cast("string") == F.col("first"), "").otherwise(","), "feature").alias("line"))  # one row
    ends = features.sparkSession.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "part int, line string")
    return body.unionByName(ends.select(F.struct("part", F.lit("").alias("n")).alias("order"), "line"))


def datasets(layer: DataFrame) -> DataFrame:
    """Rows (name, frame, resolution, x, y, z, value) to name and cells; a set of over CELLS cells in several of the same name.

    Rows are dealt out by hashed places in the input, not by values, so that equal rows part as well.
    """
    counts = layer.groupBy("name").count().select(F.col("name").alias("__name"), F.ceil(F.col("count") / CELLS).alias("__parts"))
    rows = layer.withColumn("__at", F.xxhash64(F.monotonically_increasing_id())).join(counts, F.col("name").eqNullSafe(F.col("__name")))
    return rows.groupBy("name", F.pmod("__at", "__parts").alias("__part")).agg(F.collect_list(F.struct("frame", "resolution", *XYZ, "value")).alias("cells")).select("name", "cells")


def write_dataset(layer: DataFrame, path: str) -> None:
    """Rows (name, frame, resolution, x, y, z, value) as JSON lines, one data set a name, or several of over CELLS cells."""
    datasets(layer).write.json(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET).json(path).select("name", F.inline("cells"))


def occupancy_grid(layer: DataFrame) -> DataFrame:
    """x, y and 0 to 100."""
    value = F.round(100 / (1 + F.exp(-F.col("l"))))
    return layer.groupBy("x", "y").agg(F.max(value).cast("int").alias("value"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype("<f4") if batch.num_rows else np.zeros((0, batch.num_columns), "<f4")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in table], pa.binary())], ["data"])


def point_cloud(voxels: DataFrame, size: float, intensity: Column | None = None) -> DataFrame:
    """Twelve bytes a point: x, y, z as little-endian floats, and four more with an intensity; a cloud's data are its rows one
    after another."""
    shipped(voxels.sparkSession)
    columns = [(F.col(c) * size).cast("double").alias(c) for c in XYZ]
    return voxels.select(*columns, *([intensity.cast("double").alias("intensity")] if intensity is not None else [])).mapInArrow(_packed, "data binary")


def _unpacked_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(d, "<f4").astype(float) for d in batch.column(0).to_pylist()]
        columns = [pa.array([float(r[k]) if k < len(r) else None for r in rows], pa.float64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, [*XYZ, "intensity"])


def read_point_cloud(cloud: DataFrame) -> DataFrame:
    """x, y, z and intensity (null without one) of a cloud's rows."""
    shipped(cloud.sparkSession)
    return cloud.select("data").mapInArrow(_unpacked_points, "x double, y double, z double, intensity double")


def mesh_text(vertices: DataFrame, triangles: DataFrame, kind: str) -> DataFrame:
    """Lines (order, line) of a PLY, OBJ or STL file. vertices: vid from 0, vx, vy, vz; triangles: tid, a, b, c (vids)."""
    v = vertices.select("vid", F.concat_ws(" ", "vx", "vy", "vz").alias("t"))
    if kind in ("ply", "obj"):
        face = F.concat(F.lit("3 "), F.concat_ws(" ", "a", "b", "c")) if kind == "ply" else F.concat(F.lit("f "), F.concat_ws(" ", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1))
        body = v.select(F.lit(1).alias("part"), F.col("vid").alias("n"), (F.col("t") if kind == "ply" else F.concat(F.lit("v "), "t")).alias("line"))
        body = body.unionByName(triangles.select(F.lit(2).alias("part"), F.col("tid").alias("n"), face.alias("line")))
        if kind == "obj":
            return body.select(F.struct("part", "n").alias("order"), "line")
        counts = vertices.agg(F.count("*").alias("nv")).crossJoin(triangles.agg(F.count("*").alias("nt")))
        head = F.concat_ws("\n", F.lit("ply\nformat ascii 1.0"), F.concat(F.lit("element vertex "), "nv"), F.lit("property float x\nproperty float y\nproperty float z"), F.concat(F.lit("element face "), "nt"), F.lit("property list uchar int vertex_indices\nend_header"))
        body = body.unionByName(counts.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), head.alias("line")))
        return body.select(F.struct("part", "n").alias("order"), "line")
    p = vertices.select("vid", F.array("vx", "vy", "vz").alias("p"))
    out = triangles
    for c in "abc":
        out = out.join(p.select(F.col("vid").alias(c), F.col("p").alias(f"p{c}")), c)
    u = [F.col("pb")[i] - F.col("pa")[i] for i in range(3)]
    w = [F.col("pc")[i] - F.col("pa")[i] for i in range(3)]
    n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    normal = F.concat_ws(" ", *[F.when(size > 1e-12, c / size).otherwise(F.lit(0.0 if i < 2 else 1.0)) for i, c in enumerate(n)])
    corner = lambda c: F.concat(F.lit("vertex "), F.array_join(F.col(f"p{c}").cast("array<string>"), " "))
    line = F.concat_ws("\n", F.concat(F.lit("facet normal "), normal), F.lit("outer loop"), corner("a"), corner("b"), corner("c"), F.lit("endloop\nendfacet"))
    return out.select(F.struct(F.lit(1).alias("part"), F.col("tid").alias("n")).alias("order"), line.alias("line"))


def packed(codec: str, data: bytes) -> bytes:
    if codec == "none":
        return data
    if codec == "zstd":
        return pa.Codec("zstd").compress(data, asbytes=True)
    return struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)


def container_bytes(payloads: list[bytes], codec: str = "none") -> bytes:
    """A container of frames, FRAMES_MOST at most. Header: magic, version (1 byte), flags (1), frames (4), reserved (2). Then all
    frame headers: codec, its version, graph, reserved (1 byte each), bytes unpacked, bytes packed, CRC-32 of the packed bytes (4
    each). Then the frames. Numbers have their highest byte first."""
    if len(payloads) > FRAMES_MOST:
        raise ValueError("more frames than a reader takes")
    bodies = [packed(codec, p) for p in payloads]
    heads = [struct.pack(">BBBBIII", CODECS[codec], 1, 0, 0, len(p), len(b), zlib.crc32(b)) for p, b in zip(payloads, bodies, strict=True)]
    return MAGIC + struct.pack(">BBIxx", 1, 0, len(payloads)) + b"".join(heads) + b"".join(bodies)


def container_frames(data: bytes) -> list[bytes]:
    """Raises ValueError on wrong magic, version, codec, size, or checksum."""
    if len(data) < 16 or data[:8] != MAGIC:
        raise ValueError("not a container")
    version, _, n = struct.unpack_from(">BBI", data, 8)
    at = 16 + 16 * n
    if version != 1 or n > FRAMES_MOST or at > len(data):
        raise ValueError("version or frame count is out of range")
    out = []
    for i in range(n):
        codec, _, _, _, full, size, crc = struct.unpack_from(">BBBBIII", data, 16 + 16 * i)
        if codec not in CODECS.values() or size > PACKED_MOST or full > UNPACKED_MOST or at + size > len(data):
            raise ValueError("a frame's header is out of range")
        body = data[at : at + size]
        if zlib.crc32(body) != crc:
            raise ValueError("a frame's checksum is wrong")
        out.append(unpacked(codec, body, full))
        at += size
    return out


def unpacked(codec: int, body: bytes, full: int) -> bytes:
    if codec == CODECS["none"]:
        return body
    if codec == CODECS["zstd"]:
        return pa.Codec("zstd").decompress(body, full).to_pybytes()
    return pa.Codec("lz4_raw").decompress(body[4:], full).to_pybytes()  # after the size


def frame_rows(read):
    """Rows of the frames that read() finds in a container; numbered from the one that a third column names, or from 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = batch.column(2).to_pylist() if batch.num_columns > 2 else [0] * batch.num_rows
            for path, data, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), firsts, strict=True):
                found = read(data)
                number = range(first, first + len(found))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(number, pa.int64()), pa.array(found, pa.binary())], FRAME_NAMES)

    return rows


def frames_in(data: DataFrame, read) -> DataFrame:
    """path, frame, payload of containers (path, data, and first where they are parts of a longer one)."""
    return python_rows(data.select(F.col("path").cast("string"), "data", *(["first"] if "first" in data.columns else [])), frame_rows(read), FRAME)


def in_parts(frames: DataFrame, most: int, make) -> DataFrame:
    """container, part, first (number of the first frame), data: by make(payloads, part), of at most ``most`` frames that follow
    one another; a gap begins another container."""
    if most < 1:
        raise ValueError("a container must take a frame")
    shipped(frames.sparkSession)

    def write(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq")
        seq, part, payloads = pdf["seq"].to_numpy(), int(pdf["part"].iloc[0]), [bytes(p) for p in pdf["payload"]]
        cuts = [0, *(np.flatnonzero(np.diff(seq) != 1) + 1).tolist(), len(seq)]
        data = [make(payloads[a:b], part) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame({"container": [pdf["container"].iloc[0]] * len(data), "part": part, "first": seq[cuts[:-1]], "data": data})

    kind = dict(frames.dtypes)["container"]
    parts = frames.select("container", F.floor(F.col("seq") / most).alias("part"), "seq", "payload")
    return parts.groupBy("container", "part").applyInPandas(write, f"container {kind}, part long, first long, data binary")


def containers(frames: DataFrame, codec: str = "none", most: int = 1000) -> DataFrame:
    """frames (container, seq from 0 without gaps, payload) to container, part, first, data: containers of at most ``most`` frames,
    and of no more than a reader takes."""
    return in_parts(frames, min(most, FRAMES_MOST), lambda payloads, _: container_bytes(payloads, codec))


def frames_of(data: DataFrame) -> DataFrame:
    """path, frame, payload of containers (path, data; first where they are parts of a longer one)."""
    return frames_in(data, container_frames)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, payload of all containers under a path; files go to tasks whole."""
    return frames_in(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data")), container_frames)
