"""Binary files: framed containers of format 2, CBOR data sets, binary meshes.

Spark has no sink for bytes, so a writer here gives rows of bytes; a file is its rows one after another.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import python_rows, shipped
from .files import CODECS, DATASET, PACKED_MOST, UNPACKED_MOST, datasets, frames_in, in_parts, packed, unpacked

#: Container format 2, fixed values: magic, bytes of the header, of an entry of the table of contents and of the footer, flag of hashes.
MAGIC_2, HEADER, ENTRY, FOOTER, HASHED = b"OCTA3D2\0", 32, 32, 32, 1


def stream_bytes(payloads: list[bytes], stream: int = 0, codec: str = "lz4", hashed: bool = False, every: int = 1000, every_bytes: int = 64 << 20) -> bytes:
    """A container of format 2. Header: magic, version (1 byte), flags (1), reserved (6), stream id (8), where the first frame is (8).
    Each frame: a header as in format 1, the packed bytes, and their unpacked SHA-256 where the flag says so. After ``every`` frames or
    ``every_bytes``, and at the end: a table of contents of all frames so far (place 8, bytes unpacked 4, packed 4, codec, graph,
    level, tier 1 each, number 8, reserved 4) and a footer (the table's place, bytes and entries, flags; 8 each)."""
    out = bytearray(MAGIC_2 + struct.pack(">BB6xQQ", 2, HASHED if hashed else 0, stream, HEADER))
    table = bytearray()
    since = count = 0
    for i, data in enumerate(payloads):
        body = packed(codec, data)
        table += struct.pack(">QIIBBBBQ4x", len(out), len(data), len(body), CODECS[codec], 0, 0, 0, i)
        out += struct.pack(">BBBBIII", CODECS[codec], 0, 0, 0, len(data), len(body), zlib.crc32(body)) + body + (hashlib.sha256(data).digest() if hashed else b"")
        since, count = since + len(body), count + 1
        if count == every or since >= every_bytes or i == len(payloads) - 1:
            out += table + struct.pack(">QQQQ", len(out), len(table), i + 1, HASHED if hashed else 0)
            since = count = 0
    return bytes(out)


def stream_frames(data: bytes) -> list[bytes]:
    """All frames, by the last footer. Raises ValueError on what stream_bytes can't have written."""
    if len(data) < HEADER or data[:8] != MAGIC_2 or data[8] != 2:
        raise ValueError("not a container of format 2")
    if len(data) == HEADER:
        return []
    if len(data) < HEADER + FOOTER:
        raise ValueError("no footer")
    at, size, n, flags = struct.unpack_from(">QQQQ", data, len(data) - FOOTER)
    if flags != data[9] or size != n * ENTRY or at + size + FOOTER != len(data):
        raise ValueError("the footer is wrong")
    out = []
    for i in range(n):
        place, full, packed, codec, _, _, _, number = struct.unpack_from(">QIIBBBBQ", data, at + i * ENTRY)
        if number != i or codec not in CODECS.values() or packed > PACKED_MOST or full > UNPACKED_MOST or place + 16 + packed > at:
            raise ValueError("an entry is out of range")
        body = data[place + 16 : place + 16 + packed]
        if struct.unpack_from(">BBBBIII", data, place)[4:] != (full, packed, zlib.crc32(body)):
            raise ValueError("a frame's header or checksum is wrong")
        frame = unpacked(codec, body, full)
        if flags & HASHED and hashlib.sha256(frame).digest() != data[place + 16 + packed : place + 48 + packed]:
            raise ValueError("a frame's hash is wrong")
        out.append(frame)
    return out


def stream_containers(frames: DataFrame, codec: str = "lz4", hashed: bool = False, most: int = 1000) -> DataFrame:
    """frames (container, seq from 0 without gaps, payload) to container, part, first, data: containers of at most ``most`` frames,
    so that a long stream is dealt out over tasks and its tables of contents, each of all frames so far, stay short."""
    return in_parts(frames, most, lambda payloads, part: stream_bytes(payloads, part, codec, hashed))


def stream_frames_of(data: DataFrame) -> DataFrame:
    """path, frame, payload of containers of format 2 (path, data; first where they are parts of a longer one)."""
    return frames_in(data, stream_frames)


def block_bytes(held: DataFrame, codec: str = "lz4") -> DataFrame:
    """Dense blocks (bx, by, bz, values) as packed little-endian floats: bx, by, bz, data."""
    shipped(held.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [packed(codec, np.asarray(v, dtype="<f4").tobytes()) for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["bx", "by", "bz", "data"])

    return held.select("bx", "by", "bz", "values").mapInArrow(rows, "bx long, by long, bz long, data binary")


def blocks_of_bytes(data: DataFrame, codec: str = "lz4", size: int = 512) -> DataFrame:
    shipped(data.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(unpacked(CODECS[codec], d, 4 * size), dtype="<f4").astype(float).tolist() for d in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.list_(pa.float64()))], ["bx", "by", "bz", "values"])

    return data.select("bx", "by", "bz", "data").mapInArrow(rows, "bx long, by long, bz long, values array<double>")


def _bytes_of_cbor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A data set at once, since its cells take many times its bytes."""
    for batch in batches:
        for data in batch.column(0):
            found = from_cbor(data.as_py())
            cells = [{k: float(c[k]) if k == "value" else c[k] for k in _CELL} for c in found["cells"]]
            yield pa.RecordBatch.from_arrays([pa.array([found["name"]], pa.string()), pa.array([cells], pa.list_(_KIND))], ["name", "cells"])


def datasets_of(data: DataFrame) -> DataFrame:
    """Rows of CBOR data sets (data)."""
    return python_rows(data.select("data"), _bytes_of_cbor, DATASET).select("name", F.inline("cells"))


def read_stream_containers(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, payload of all containers of format 2 under a path."""
    return frames_in(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data")), stream_frames)


def cbor(value) -> bytes:
    """CBOR (RFC 8949) of None, booleans, integers of 64 bits, floats, text, lists and maps."""

    def head(kind: int, n: int) -> bytes:
        if n < 24:
            return bytes([kind << 5 | n])
        size = next(i for i in range(4) if n < 1 << (8 << i))
        return bytes([kind << 5 | 24 + size]) + n.to_bytes(1 << size, "big")

    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        return head(3, len(value.encode())) + value.encode()
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(cbor(k) + cbor(v) for k, v in value.items())
    return head(4, len(value)) + b"".join(map(cbor, value))


def from_cbor(data: bytes):
    """The value; lengths may be open, floats of any size. Raises ValueError on other kinds and on cut or further bytes."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the data end early")
        at += n
        return data[at - n : at]

    def item():
        nonlocal at
        kind, low = divmod(take(1)[0], 32)
        if kind == 7:
            if low in (25, 26, 27):
                return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], take(1 << low - 24))[0]
            if low not in (20, 21, 22):
                raise ValueError("a simple value isn't known")
            return {20: False, 21: True, 22: None}[low]
        n = low if low < 24 else int.from_bytes(take(1 << low - 24), "big") if low < 28 else None
        if n is None and (low != 31 or kind not in (3, 4, 5)):
            raise ValueError("a length isn't known")
        if kind < 2:
            return n if kind == 0 else -1 - n
        if kind == 3 and n is not None:
            return take(n).decode()
        if kind not in (3, 4, 5):
            raise ValueError("a kind isn't known")
        held = []
        while len(held) < (math.inf if n is None else n):
            if n is None and data[at : at + 1] == b"\xff":
                at += 1
                break
            held.append((item(), item()) if kind == 5 else item())
        return "".join(held) if kind == 3 else held if kind == 4 else dict(held)

    out = item()
    if at != len(data):
        raise ValueError("bytes follow")
    return out


_CELL = ("frame", "resolution", "x", "y", "z", "value")
_KIND = pa.struct([("frame", pa.int32()), ("resolution", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("z", pa.int32()), ("value", pa.float64())])


def cbor_datasets(layer: DataFrame) -> DataFrame:
    """Rows (name, frame, resolution, x, y, z, value) to name and data, a CBOR data set a name, or several of over CELLS cells."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, cells in zip(*batch.columns, strict=True):
                data = cbor({"name": name.as_py(), "cells": cells.as_py()})
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([data], pa.binary())], ["name", "data"])

    return python_rows(datasets(layer), rows, "name string, data binary")


def read_cbor_datasets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all CBOR data sets under a path."""
    return datasets_of(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")))


def _records(names: list[str], shape: list):
    """Columns as packed records, one a row; the first column stays."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=shape)
            for (field, *_), column in zip(shape, names, strict=False):
                out[field] = batch.column(column).to_numpy(zero_copy_only=False)
            size = out.dtype.itemsize
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], ["n", "data"])

    return rows


def mesh_bytes(vertices: DataFrame, triangles: DataFrame, kind: str) -> DataFrame:
    """Pieces (order, data) of a binary PLY (lowest byte first) or STL file, to be put together by order.

    vertices: vid from 0, vx, vy, vz; triangles: tid, a, b, c (vids). STL normals follow the corners, or point up without an area.
    """
    shipped(vertices.sparkSession)
    piece = lambda df, part: df.select(F.struct(F.lit(part).alias("part"), F.col("n").cast("long").alias("n")).alias("order"), "data")
    if kind == "ply":
        counts = vertices.agg(F.count("*").alias("nv")).crossJoin(triangles.agg(F.count("*").alias("nt")))  # one row each
        head = F.format_string(
            "ply\nformat binary_little_endian 1.0\nelement vertex %d\nproperty float x\nproperty float y\nproperty float z\n"
            "element face %d\nproperty list uchar int vertex_indices\nend_header\n", "nv", "nt"
        )
        points = vertices.select("vid", "vx", "vy", "vz").mapInArrow(_records(["vx", "vy", "vz"], [("x", "<f4"), ("y", "<f4"), ("z", "<f4")]), "n long, data binary")
        faces = triangles.select("tid", F.lit(3).alias("k"), "a", "b", "c").mapInArrow(_records(["k", "a", "b", "c"], [("k", "u1"), ("a", "<i4"), ("b", "<i4"), ("c", "<i4")]), "n long, data binary")
        return piece(counts.select(F.lit(0).alias("n"), F.encode(head, "UTF-8").alias("data")), 0).unionByName(piece(points, 1)).unionByName(piece(faces, 2))
    corners = vertices.select("vid", F.array("vx", "vy", "vz").alias("p"))
    out = triangles
    for c in "abc":
        out = out.join(corners.select(F.col("vid").alias(c), F.col("p").alias(f"p{c}")), c)
    u, w = ([F.col(f"p{c}")[i] - F.col("pa")[i] for i in range(3)] for c in "bc")
    normal = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    size = F.sqrt(sum((c * c for c in normal), F.lit(0.0)))
    values = [F.when(size > 1e-12, c / size).otherwise(F.lit(float(i == 2))) for i, c in enumerate(normal)] + [F.col(f"p{c}")[i] for c in "abc" for i in range(3)]
    names = [f"f{i}" for i in range(12)]
    facets = out.select("tid", *[v.cast("double").alias(n) for v, n in zip(values, names, strict=True)]).mapInArrow(_records(names, [*[(n, "<f4") for n in names], ("pad", "<u2")]), "n long, data binary")
    start = triangles.agg(F.count("*").alias("nt")).select(F.lit(0).cast("long").alias("n"), "nt")
    start = start.mapInArrow(_records(["nt"], [("nt", "<u4")]), "n long, data binary").select("n", F.concat(F.lit(b"binary STL".ljust(80)), "data").alias("data"))
    return piece(start, 0).unionByName(piece(facets, 1))
