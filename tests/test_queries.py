"""Queries against their SQL, run by DuckDB on the same tables."""

import hashlib
import math
from pathlib import Path

import duckdb
import pytest

from vertexloom.plans import catalogue, keys, worlds  # noqa: F401

SF = "/root/testdata/sf0.001"


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str([shown(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    out = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert found == sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in out.fetchall())


def test_maze_is_the_least_spanning_tree(spark):
    from vertexloom.functions import ids
    from vertexloom.operators import topology

    cells = catalogue._free(spark, SF).withColumn("key", ids.morton(*catalogue.col("x", "y", "z")))
    edges = topology.with_neighbor_values(cells, "key").selectExpr("least(key, n_value) a", "greatest(key, n_value) b").distinct().collect()
    weight = lambda a, b: (int(hashlib.md5(f"7:{a}:{b}".encode()).hexdigest()[:15], 16), a, b)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    expected = set()
    for _, a, b in sorted(weight(r.a, r.b) for r in edges):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            expected.add((a, b))
    assert {(r.a, r.b) for r in catalogue.queries()["maze"](spark, SF).collect()} == expected


def test_view_scores(spark):
    """Against a walk along each ray in plain Python."""
    from vertexloom.functions import lattice
    from vertexloom.operators import layers

    layer = spark.createDataFrame([(x, y, z, 2.0 if x == 4 else -2.0) for x in range(6) for y in range(6) for z in range(6) if x % 2 == y % 2 == z % 2], "x long, y long, z long, l double")
    views = spark.createDataFrame([("a", 3.1, 2.2, 1.3, 1.0, 0.0, 0.0), ("b", 0.2, 0.4, 5.1, 0.0, -1.0, 0.0), ("c", 50.0, 50.0, 50.0, 0.6, 0.8, 0.0)], "view string, px double, py double, pz double, dx double, dy double, dz double")
    known = {(r.x, r.y, r.z) for r in layer.collect()}
    found = {r.view: r.gain for r in layers.information_gain(views, layer, reach=3.0, step=0.2).collect()}
    for v in views.collect():
        cells = set()
        n = int(1.0471975511965976 / 2 / 0.2)
        for i in range(-n, n + 1):
            for j in range(-n, n + 1):
                yaw, pitch = i * 0.2, j * 0.2
                d = [v.dx * math.cos(yaw) - v.dy * math.sin(yaw), v.dx * math.sin(yaw) + v.dy * math.cos(yaw), v.dz + math.sin(pitch)]
                size = math.sqrt(sum(c * c for c in d))
                for k in range(1, 7):
                    p = [math.floor(a + c / size * k * 0.5 + 0.5) for a, c in zip((v.px, v.py, v.pz), d, strict=True)]
                    odd = sum(c & 1 for c in p)
                    cells.add(tuple(c ^ 1 if (c & 1 == 1) != (odd >= 2) else c for c in p))
        assert found[v.view] == len(cells - known), v
    assert found["c"] > 0 and lattice.MAX_SNAP_ERROR > 0
    assert catalogue.queries()["view_scores"](spark, SF).filter("gain >= 0").count() == 24


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
