import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vertexloom.sources import binary

PAYLOADS = [b"one", b"", b"three" * 500, bytes(range(256))]


@pytest.mark.parametrize("codec", ["lz4", "zstd", "none"])
@pytest.mark.parametrize("hashed", [False, True])
@pytest.mark.parametrize("every", [1, 2, 1000])
def test_streams(codec, hashed, every):
    data = binary.stream_bytes(PAYLOADS, 7, codec, hashed, every)
    assert binary.stream_frames(data) == PAYLOADS
    assert data[:10] == b"OCTA3D2\0\x02" + bytes([hashed]) and data[16:32] == struct.pack(">QQ", 7, 32)
    for bad in (data[:-1], data[:20], b"X" + data[1:], data[:48] + bytes([data[48] ^ 1]) + data[49:]):
        with pytest.raises(ValueError):
            binary.stream_frames(bad)


def test_stream_without_frames():
    assert binary.stream_frames(binary.stream_bytes([])) == []


def test_stream_containers(spark, tmp_path):
    frames = spark.createDataFrame([(k, i, f"{k}{i}".encode()) for k in "ab" for i in range(7)], "container string, seq long, payload binary")
    for r in binary.stream_containers(frames, hashed=True, most=3).collect():
        (tmp_path / f"{r.container}{r.part}.bin").write_bytes(r.data)
    found = binary.read_stream_containers(spark, f"file://{tmp_path}").collect()
    assert len(list(tmp_path.iterdir())) == 6
    assert sorted(bytes(r.payload) for r in found) == sorted(f"{k}{i}".encode() for k in "ab" for i in range(7))
    assert binary.stream_containers(frames.limit(0)).count() == 0


def test_long_streams_are_cut(spark, monkeypatch):
    """Tables of contents list all frames so far, so that a long stream in one container grows with its square; numbers stay."""
    from vertexloom.plans import worlds

    frames = spark.range(0, 5000, 1, 1).selectExpr("'a' as container", "id + if(id >= 2500, 10, 0) as seq", "encode(string(id), 'UTF-8') as payload")
    data = binary.stream_containers(frames, hashed=True)
    assert max(len(binary.stream_frames(bytes(r.data))) for r in data.collect()) == 1000
    found = binary.stream_frames_of(data.selectExpr("container as path", "first", "data"))
    assert sorted((r.frame, bytes(r.payload)) for r in found.collect()) == sorted((r.seq, bytes(r.payload)) for r in frames.collect())
    held = []
    read = lambda data: held.extend(data.collect()) or binary.frames_in(data, binary.stream_frames)
    monkeypatch.setattr(binary, "stream_frames_of", read)
    assert worlds.stream_containers(spark, "/root/testdata/sf0.1").count() == 15000
    sizes = [len(binary.stream_frames(bytes(r.data))) for r in held]
    assert sum(sizes) == 15000 and max(sizes) <= 1000


PLAIN = st.none() | st.booleans() | st.integers(-(2**63), 2**63) | st.floats(allow_nan=False) | st.text()


@given(st.recursive(PLAIN, lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20))
def test_cbor(value):
    assert binary.from_cbor(binary.cbor(value)) == value


def test_cbor_by_the_standard():
    known = [("1903e8", 1000), ("3863", -100), ("fb3ff199999999999a", 1.1), ("62c3bc", "ü"), ("a26161016162820203", {"a": 1, "b": [2, 3]})]
    for written, value in known:
        assert binary.cbor(value).hex() == written
    for written, value in [*known, ("f93e00", 1.5), ("fa47c35000", 100000.0), ("9f0102ff", [1, 2]), ("bf6161f5ff", {"a": True}), ("7f61616162ff", "ab")]:
        assert binary.from_cbor(bytes.fromhex(written)) == value
    for bad in ("", "19", "0101", "8201", "f8ff", "5f", "1c"):
        with pytest.raises(ValueError):
            binary.from_cbor(bytes.fromhex(bad))


def test_cbor_datasets(spark, tmp_path):
    layer = spark.createDataFrame([("a", 0, 5, 2, 4, -6, 1.5), ("b", 1, 5, 1, 1, 1, 2.0), ("b", 1, 5, 3, 1, 1, None)], "name string, frame int, resolution int, x int, y int, z int, value double")
    whole = layer.filter("value is not null")
    for r in binary.cbor_datasets(whole).collect():
        (tmp_path / f"{r.name}.cbor").write_bytes(r.data)
    assert sorted(binary.read_cbor_datasets(spark, f"file://{tmp_path}").collect()) == sorted(whole.collect())


def test_meshes(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0)], "vid long, vx double, vy double, vz double")
    triangles = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 1, 2)], "tid long, a long, b long, c long")
    file = lambda kind: b"".join(bytes(r.data) for r in binary.mesh_bytes(vertices, triangles, kind).orderBy("order").collect())
    ply = file("ply")
    head, body = ply.split(b"end_header\n")
    assert b"element vertex 3\n" in head and b"element face 2\n" in head
    assert body == struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 2, 0) + struct.pack("<B3iB3i", 3, 0, 1, 2, 3, 1, 1, 2)
    stl = file("stl")
    assert len(stl) == 84 + 2 * 50 and stl[80:84] == struct.pack("<I", 2)
    assert stl[84:134] == struct.pack("<12fH", 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 2, 0, 0)
    assert struct.unpack_from("<3f", stl, 134) == (0, 0, 1)


def test_large_data_sets_come_in_parts(spark, tmp_path):
    """A set is made and read whole by one task, so that a large one is several of its name; of equal rows too, and without a name. A small one stays one."""
    from vertexloom.sources import files

    n = 5 * files.CELLS // 2
    cells = ["0 as frame", "5 as resolution", "2 as x", "4 as y", "-6 as z", "1.5D as value"]
    layer = spark.range(0, n, 1, 1).selectExpr("'a' as name", *cells).union(spark.range(0, n, 1, 1).selectExpr("cast(null as string) as name", *cells)).union(spark.range(0, 10, 1, 4).selectExpr("'b' as name", *cells))
    data = binary.cbor_datasets(layer)
    sets = [binary.from_cbor(bytes(r.data)) for r in data.collect()]
    sizes = {k: [len(s["cells"]) for s in sets if s["name"] == k] for k in ("a", None, "b")}
    assert {k: sum(v) for k, v in sizes.items()} == {"a": n, None: n, "b": 10}
    assert max(sizes["a"] + sizes[None]) < files.CELLS and sizes["b"] == [10]
    files.write_dataset(layer, f"file://{tmp_path}/sets")
    assert spark.read.schema(files.DATASET).json(f"file://{tmp_path}/sets").selectExpr("max(size(cells)) as m").first().m < files.CELLS
    for found in (binary.datasets_of(data), files.read_dataset(spark, f"file://{tmp_path}/sets")):
        counts = found.groupBy("name", *[c for c in found.columns if c != "name"]).count().collect()
        assert {tuple(r) for r in counts} == {(k, 0, 5, 2, 4, -6, 1.5, sum(v)) for k, v in sizes.items()}
