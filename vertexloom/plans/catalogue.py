"""All queries of the engine and their SQL. Floats are rounded to 6 places in both, since sums may differ in the last bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, lattice, text
from ..operators import layers, topology
from ..operators.topology import XYZ
from ..sources import files, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def col(*names):
    return [F.col(n) for n in names]


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# SQL of the inputs. ---------------------------------------------------------------------------------------------------


def _snap(x: str, y: str, z: str, source: str, others: str = "") -> str:
    out = ", ".join(f"xor({c}, CASE WHEN (({c} & 1) = 1) <> ((x & 1) + (y & 1) + (z & 1) >= 2) THEN 1 ELSE 0 END)::BIGINT AS {c}" for c in XYZ)
    names = ", ".join(o.rsplit(" AS ", 1)[1] for o in others.split(" ; ")) if others else ""
    inner = ", ".join(others.split(" ; ")) if others else ""
    return f"SELECT {out}{', ' + names if names else ''} FROM (SELECT ({x})::BIGINT AS x, ({y})::BIGINT AS y, ({z})::BIGINT AS z{', ' + inner if inner else ''} FROM {source})"


_LINE = ("l_partkey % 32", "l_suppkey % 32", "(l_orderkey + l_linenumber) % 32", "lineitem")
CELLS = _snap(*_LINE, "l_extendedprice AS value")
SIGNED = _snap("c_custkey % 200 - 100", "(c_custkey * 7) % 200 - 100", "(c_custkey * 13) % 200 - 100", "customer", "c_custkey AS id")
POINTS = "SELECT vec_id AS id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings"
OBS = _snap("user_id % 16", "event_id % 16", "(event_id // 16) % 16", "events", "ts AS ts ; event_id AS seq ; event_type IN ('error', 'purchase') AS occupied ; 0.55 + 0.4 * (value % 100) / 100 AS confidence")
SDF = _snap(*_LINE, "(l_discount - 0.05) * 2 AS sdf ; {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice} AS seq")


def _spread(c: str) -> str:
    v = f"({c})::BIGINT"
    return "(" + " | ".join(f"((({v} >> {i}) & 1) << {3 * i})" for i in range(16)) + ")"


def _morton(x: str = "x", y: str = "y", z: str = "z") -> str:
    return f"({_spread(x)} | ({_spread(y)} << 1) | ({_spread(z)} << 2))"


_MIN = "(-9223372036854775808)::BIGINT"
_LEVEL5 = "(5::BIGINT << 48)"
_INDEX = f"({_MIN} + ({_LEVEL5} | {_morton()}))"
_GRAY = f"xor(m, (m >> 1) & {0x6DB6DB6DB6DB})"
_ALONE = "((x >> 1) & 1) + ((y >> 1) & 1) + ((z >> 1) & 1)"


def _parent(c: str) -> str:
    h = f"({c} >> 1)"
    even = f"CASE WHEN ({_ALONE} = 1 AND ({h} & 1) = 1) OR ({_ALONE} = 2 AND ({h} & 1) = 0) THEN {h} - 1 ELSE {h} END"
    first = "((x - 1) >> 1)"
    low, high = f"(({c} - 1) >> 1)", f"(({c} + 1) >> 1)"
    uneven = first if c == "x" else f"CASE WHEN ({low} & 1) = ({first} & 1) THEN {low} ELSE {high} END"
    return f"CASE WHEN (x & 1) = 0 THEN {even} ELSE {uneven} END"


_PARENT = ", ".join(f"({_parent(c)})::BIGINT AS p{c}" for c in XYZ)
_NEIGHBORS = "(VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(lattice.NEIGHBORS)) + ") AS n(slot, a, b, c)"
_STATS = "count(*)::DOUBLE AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median"


def _ring(k: int) -> str:
    return "(VALUES " + ", ".join(f"({a}, {b}, {c}, {h})" for a, b, c, h in lattice.ring_offsets(k)) + ") AS o(a, b, c, hop)"


def _sorted_deltas(dx: str, dy: str, dz: str) -> tuple[str, str]:
    most, least = f"greatest(abs({dx}), abs({dy}), abs({dz}))", f"least(abs({dx}), abs({dy}), abs({dz}))"
    return most, f"(abs({dx}) + abs({dy}) + abs({dz}) - {most} - {least})"


# Keys. ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT {_INDEX} AS cell, count(*)::BIGINT AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM ({CELLS}) GROUP BY 1")
def cell_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and a key at one level stand for each other, so that a key is made once a cell, not once a row."""
    cells = tables.cells(spark, sf_dir).groupBy(*XYZ).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value"), "mean"))
    zero = F.lit(0)
    return cells.select(ids.index64(zero, zero, F.lit(5), *col(*XYZ)).alias("cell"), "n", "total", "mean")


@query(f"SELECT id, x, y, z, ((x & 1) = (y & 1) AND (y & 1) = (z & 1)) AS valid, (x & 1)::BIGINT AS parity, 1 - (x & 1)::BIGINT AS opposite, x * 2 AS sx, x::DOUBLE AS fx FROM (SELECT c_custkey AS id, c_custkey % 5 - 2 AS x, c_custkey % 7 - 3 AS y, c_custkey % 9 - 4 AS z FROM customer)")
def parity(spark, sf_dir):
    c = F.col("c_custkey").cast("long")
    rows = tables.read(spark, sf_dir, "customer").select(c.alias("id"), (c % 5 - 2).alias("x"), (c % 7 - 3).alias("y"), (c % 9 - 4).alias("z"))
    x, y, z = col(*XYZ)
    return rows.select("id", *XYZ, lattice.is_valid(x, y, z).alias("valid"), lattice.odd(x).alias("parity"), lattice.opposite(lattice.odd(x)).alias("opposite"), (x * 2).alias("sx"), x.cast("double").alias("fx"))


def _morton_cells(spark, sf_dir):
    """Distinct points first, then a code for each."""
    return tables.cells(spark, sf_dir).select(*XYZ).distinct().withColumn("m", ids.morton(*col(*XYZ)))


def _distinct_keys(spark, sf_dir):
    zero = F.lit(0)
    return _morton_cells(spark, sf_dir).select(*XYZ, ids.index_of_code(zero, zero, F.lit(5), F.col("m")).alias("cell"))


@query(f"SELECT DISTINCT x, y, z, m, g, {_MIN} + ({_LEVEL5} | m) AS cell, (-4611686018427387904)::BIGINT + ({_LEVEL5} | g) AS hilbert FROM (SELECT *, {_GRAY} AS g FROM (SELECT x, y, z, {_morton()} AS m FROM ({CELLS})))")
def curve_keys(spark, sf_dir):
    zero, five, m = F.lit(0), F.lit(5), F.col("m")
    cells = _morton_cells(spark, sf_dir)
    return cells.select(*XYZ, "m", ids.gray(m).alias("g"), ids.index_of_code(zero, zero, five, m).alias("cell"), ids.hilbert_of_code(zero, zero, five, m).alias("hilbert"))


@query(f"SELECT DISTINCT x, y, z, x AS mx, y AS my, z AS mz, x AS hx, y AS hy, z AS hz, 0::BIGINT AS frame, 0::BIGINT AS tier, 5::BIGINT AS lod, 2::BIGINT AS kind, true AS same FROM ({CELLS})")
def curve_round_trip(spark, sf_dir):
    keys = _distinct_keys(spark, sf_dir)
    k = F.col("cell")
    mx, my, mz = ids.morton_decode(ids.code(k))
    h = ids.index_to_hilbert(k)
    return keys.select(*XYZ, mx.alias("mx"), my.alias("my"), mz.alias("mz"), *[c.alias(f"h{n}") for c, n in zip(ids.morton_decode(ids.gray_decode(ids.code(h))), XYZ, strict=True)], ids.frame(k).alias("frame"), ids.tier(k).alias("tier"), ids.lod(k).alias("lod"), ids.kind(k).alias("kind"), (ids.hilbert_to_index(h) == k).alias("same"))


@query(f"SELECT id, (4611686018427387904 + ((x & 1048575) << 40) + ((y & 1048575) << 20) + (z & 1048575))::BIGINT AS route, x AS rx, y AS ry, z AS rz, true AS valid, 'R64(t=0,x=' || x || ',y=' || y || ',z=' || z || ')' AS shown FROM ({SIGNED})")
def route_keys(spark, sf_dir):
    rows = tables.signed_cells(spark, sf_dir).withColumn("route", ids.route64(F.lit(0), *col(*XYZ)))
    k = F.col("route")
    return rows.select("id", "route", *[c.alias(f"r{n}") for n, c in zip(XYZ, ids.route_coords(k), strict=True)], ids.route_valid(k).alias("valid"), ids.display_route(k).alias("shown"))


@query(f"SELECT id, ((5::BIGINT << 56) | (1::BIGINT << 54) | (10::BIGINT << 48) | (1::BIGINT << 36) | (3::BIGINT << 32) | (x & 4294967295))::BIGINT AS hi, (CASE WHEN y < 0 THEN (y * 4294967296) ELSE (y << 32) END | (z & 4294967295))::BIGINT AS lo, x AS gx, y AS gy, z AS gz, 10::BIGINT AS lod FROM ({SIGNED})")
def galactic_keys(spark, sf_dir):
    lit = F.lit
    rows = tables.signed_cells(spark, sf_dir).withColumn("g", ids.galactic128(lit(0), lit(5), lit(1), lit(10), lit(3), *col(*XYZ)))
    f = ids.galactic_fields(F.col("g"))
    return rows.select("id", "g.hi", "g.lo", *[f[c].alias(f"g{c}") for c in XYZ], f["lod"].alias("lod"))


@query(f"SELECT id, x AS cx, y AS cy, z AS cz, 2::BIGINT AS resolution, 5::BIGINT AS flags, row_number() OVER (ORDER BY (z & 4294967295), (y & 4294967295), (x & 4294967295), id)::INT AS place FROM ({SIGNED})")
def cell_id_order(spark, sf_dir):
    lit = F.lit
    rows = tables.signed_cells(spark, sf_dir).withColumn("c", ids.cell_id(lit(0), lit(2), lit(0), lit(5), *col(*XYZ)))
    f = ids.cell_fields(F.col("c"))
    rows = topology.numbered(rows, [ids.unsigned_order(F.col("c.hi")), ids.unsigned_order(F.col("c.lo")), "id"])
    return rows.select("id", *[f[c].alias(f"c{c}") for c in XYZ], f["resolution"].alias("resolution"), f["flags"].alias("flags"), F.col("place").cast("int"))


@query("SELECT id, flags, (flags & 1) <> 0 AS blocked, (flags | 4) AS with_water, (flags & ~8) AS without_boundary FROM (SELECT c_custkey AS id, (c_custkey % 16)::INT AS flags FROM customer)")
def cell_flags(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 16).cast("int").alias("flags"))
    f = F.col("flags")
    return rows.select("id", "flags", ids.has_flag(f, "BLOCKED").alias("blocked"), ids.set_flag(f, "WATER").alias("with_water"), ids.clear_flag(f, "BOUNDARY").alias("without_boundary"))


@query("SELECT id, x, CASE WHEN x BETWEEN -524288 AND 524287 AND (x & 1) = (y & 1) THEN 'ok' ELSE 'bad' END AS result FROM (SELECT c_custkey AS id, c_custkey * 1000 - 700000 AS x, c_custkey * 2 % 100 AS y FROM customer)")
def batch_build(spark, sf_dir):
    """Keys of a batch with the rows that can't have one."""
    c = F.col("c_custkey").cast("long")
    rows = tables.read(spark, sf_dir, "customer").select(c.alias("id"), (c * 1000 - 700000).alias("x"), (c * 2 % 100).alias("y"))
    key = ids.route64(F.lit(0), F.col("x"), F.col("y"), F.col("y"))
    return rows.select("id", "x", F.when(key.isNull(), "bad").otherwise("ok").alias("result"))


_HEAD = [*(ord(c) >> 5 for c in text.PREFIXES["index"]), 0, *(ord(c) & 31 for c in text.PREFIXES["index"])]
_STEP = "xor(((c & 33554431) << 5), v)"
for _i, _g in enumerate(text.GENERATOR):
    _STEP = f"xor({_STEP}, ((c >> {25 + _i}) & 1) * {_g})"


@query(
    f"WITH c AS (SELECT DISTINCT {_INDEX} AS cell FROM ({CELLS})), "
    "g AS (SELECT cell, list_append(list_transform(range(12), lambda i: (cell >> (59 - 5 * i)::INT) & 31), (cell & 15) << 1) AS v FROM c), "
    f"s AS (SELECT cell, v, xor(list_reduce(list_concat({_HEAD}::BIGINT[], v, [0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, v: {_STEP}, 1::BIGINT), {text.CONSTANT}) AS check_ FROM g) "
    f"SELECT cell, '{text.PREFIXES['index']}1' || array_to_string(list_transform(list_concat(v, list_transform(range(6), lambda i: (check_ >> (25 - 5 * i)::INT) & 31)), lambda x: '{text.ALPHABET}'[x + 1]), '') AS shown, true AS same, "
    "printf('I64(f=%d,t=%d,l=%d,m=%012x)', (cell >> 52) & 255, (cell >> 60) & 3, (cell >> 48) & 15, cell & 281474976710655) AS fields FROM s"
)
def key_texts(spark, sf_dir):
    """Checksummed text of keys, and back."""
    keys = _distinct_keys(spark, sf_dir).select("cell").withColumn("shown", text.key_text(text.PREFIXES["index"], F.col("cell")))
    back = F.conv(F.hex(text.bech32m_decode(text.PREFIXES["index"], F.col("shown"), 8)), 16, -10).cast("long")
    return keys.select("cell", "shown", (back == F.col("cell")).alias("same"), ids.display_index(F.col("cell")).alias("fields"))


# Hierarchies. ---------------------------------------------------------------------------------------------------------


@query(f"SELECT id, x, y, z, {_PARENT} FROM ({SIGNED})")
def lattice_parents(spark, sf_dir):
    p = lattice.parent(*col(*XYZ))
    return tables.signed_cells(spark, sf_dir).select("id", *XYZ, *[c.alias(f"p{n}") for c, n in zip(p, XYZ, strict=True)])


@query("SELECT id, (2 * x + a)::BIGINT AS kx, (2 * y + b)::BIGINT AS ky, (2 * z + c)::BIGINT AS kz, x AS px, y AS py, z AS pz FROM (" + SIGNED + "), (VALUES " + ", ".join(map(str, lattice.CHILDREN)) + ") AS k(a, b, c)")
def lattice_children(spark, sf_dir):
    """Children, and their parents, which give the point back."""
    rows = tables.signed_cells(spark, sf_dir).select("id", F.explode(lattice.children(*col(*XYZ))).alias("k"))
    rows = rows.select("id", *[F.col(f"k.{c}").alias(f"k{c}") for c in XYZ])
    return rows.select("*", *[c.alias(f"p{n}") for c, n in zip(lattice.parent(*col("kx", "ky", "kz")), XYZ, strict=True)])


@query(f"SELECT cell, {_MIN} + ((4::BIGINT << 48) | (m >> 3)) AS parent, {_MIN} + ((6::BIGINT << 48) | ((m << 3) & 281474976710655)) AS first_child, {_MIN} + ((6::BIGINT << 48) | (((m << 3) | 7) & 281474976710655)) AS last_child, 8 AS n FROM (SELECT DISTINCT {_INDEX} AS cell, {_morton()} AS m FROM ({CELLS}))")
def key_hierarchy(spark, sf_dir):
    keys = _distinct_keys(spark, sf_dir).select("cell")
    k = ids.index_children(F.col("cell"))
    return keys.select("cell", ids.index_parent(F.col("cell")).alias("parent"), k[0].alias("first_child"), k[7].alias("last_child"), F.size(k).alias("n"))


# Points and cells. ----------------------------------------------------------------------------------------------------


def _nearest(scale: str) -> str:
    e = lambda c: f"round({c} * {scale} / 2) * 2"
    o = lambda c: f"(round(({c} * {scale} - 1) / 2) * 2 + 1)"
    far = lambda f: " + ".join(f"({f(c)} - {c} * {scale}) * ({f(c)} - {c} * {scale})" for c in XYZ)
    return ", ".join(f"CASE WHEN ({far(e)}) <= ({far(o)}) THEN {e(c)} ELSE {o(c)} END::BIGINT AS c{c}" for c in XYZ)


@query(f"SELECT id, cx, cy, cz, round(cx::DOUBLE / 4, 6) AS wx, round(cy::DOUBLE / 4, 6) AS wy, round(cz::DOUBLE / 4, 6) AS wz FROM (SELECT id, {_nearest('4.0')} FROM ({POINTS}))")
def grid_cells(spark, sf_dir):
    """Cells of size 0.5 at points, and their centres."""
    c = lattice.Grid(0.5).lattice_at(*col(*XYZ))
    rows = tables.points(spark, sf_dir).select("id", *[v.alias(f"c{n}") for v, n in zip(c, XYZ, strict=True)])
    return rows.select("*", *[r6(F.col(f"c{n}") * 0.25, f"w{n}") for n in XYZ])


@query(f"SELECT id, x, y, z FROM ({_snap('round(x / 0.1)', 'round(y / 0.1)', 'round(z / 0.1)', '(' + POINTS + ')', 'id AS id')})")
def voxels_of_points(spark, sf_dir):
    v = lattice.physical_to_voxel(*col(*XYZ), 0.1)
    return tables.points(spark, sf_dir).select("id", *[c.alias(n) for c, n in zip(v, XYZ, strict=True)])


@query(f"SELECT {', '.join(f'c{c}' for c in XYZ)}, count(*)::BIGINT AS n, round(avg(id), 6) AS mean FROM (SELECT id, {_nearest('2.0')} FROM ({POINTS})) GROUP BY ALL")
def point_density(spark, sf_dir):
    c = lattice.physical_to_lattice(*col(*XYZ), resolution=1)
    rows = tables.points(spark, sf_dir).select("id", *[v.alias(f"c{n}") for v, n in zip(c, XYZ, strict=True)])
    return rows.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), r6(F.avg("id"), "mean"))


@query(f"SELECT id, round(round(x / 111320.0 * 1000000) / 1000000, 6) AS lon, round(round(y / 110540.0 * 1000000) / 1000000, 6) AS lat, z::DOUBLE AS alt FROM ({SIGNED})")
def geographic(spark, sf_dir):
    frames = files.frames(spark)
    rows = tables.signed_cells(spark, sf_dir).withColumn("frame", F.lit(0))
    out = files.to_geographic(rows, frames)
    return out.select("id", r6(F.round(F.col("lon") * 1e6) / 1e6, "lon"), r6(F.round(F.col("lat") * 1e6) / 1e6, "lat"), "alt")


# Topology and distances. ----------------------------------------------------------------------------------------------

_DISTINCT = f"SELECT DISTINCT x, y, z FROM ({CELLS})"


@query(f"SELECT x + a AS nx, y + b AS ny, z + c AS nz, count(*)::BIGINT AS n, sum(slot)::BIGINT AS slots FROM ({_DISTINCT}), {_NEIGHBORS} WHERE x + a >= 0 AND y + b >= 0 AND z + c >= 0 GROUP BY 1, 2, 3")
def neighbor_counts(spark, sf_dir):
    out = topology.explode_neighbors(tables.cells(spark, sf_dir).select(*XYZ).distinct(), 0, 65535)
    return out.groupBy("nx", "ny", "nz").agg(F.count("*").alias("n"), F.sum("slot").alias("slots"))


@query(f"SELECT id, list(xyz ORDER BY slot) AS around FROM (SELECT id, slot, (x + a) || ' ' || (y + b) || ' ' || (z + c) AS xyz FROM ({SIGNED}), {_NEIGHBORS}) GROUP BY id")
def neighbors_grouped(spark, sf_dir):
    n = F.transform(lattice.neighbors(*col(*XYZ)), lambda p: F.concat_ws(" ", p["x"], p["y"], p["z"]))
    return tables.signed_cells(spark, sf_dir).select("id", n.alias("around"))


_SUMS = f"SELECT x, y, z, sum(value) AS v FROM ({CELLS}) GROUP BY x, y, z"


@query(f"WITH s AS ({_SUMS}) SELECT s.x, s.y, s.z, count(*)::BIGINT AS n, round(sum(t.v), 4) AS around FROM s, {_NEIGHBORS}, s t WHERE t.x = s.x + a AND t.y = s.y + b AND t.z = s.z + c GROUP BY 1, 2, 3")
def neighbor_values(spark, sf_dir):
    sums = tables.cells(spark, sf_dir).groupBy(*XYZ).agg(F.sum("value").alias("v"))
    return topology.with_neighbor_values(sums, "v").groupBy(*XYZ).agg(F.count("*").alias("n"), F.round(F.sum("n_value"), 4).alias("around"))


_M, _S = _sorted_deltas("(x - 10)", "(y - 20)", "(z + 30)")


@query(
    f"SELECT id, (abs(x - 10) + abs(y - 20) + abs(z + 30))::BIGINT AS manhattan, greatest(abs(x - 10), abs(y - 20), abs(z + 30))::BIGINT AS chebyshev, ((x - 10) * (x - 10) + (y - 20) * (y - 20) + (z + 30) * (z + 30))::BIGINT AS squared, "
    f"round(sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20) + (z + 30) * (z + 30)), 6) AS euclid, (({_M} + {_S}) >> 1)::BIGINT AS hops, round(sqrt(3.0) * {_S} + ({_M} - {_S}), 6) AS cost FROM ({SIGNED})"
)
def distances_to_one(spark, sf_dir):
    d = [F.col("x") - 10, F.col("y") - 20, F.col("z") + 30]
    return tables.signed_cells(spark, sf_dir).select(
        "id", lattice.manhattan(*d).alias("manhattan"), lattice.chebyshev(*d).alias("chebyshev"), lattice.euclid_squared(*d).alias("squared"), r6(lattice.euclid(*d), "euclid"), lattice.hops(*d).alias("hops"), r6(lattice.path_cost(*d), "cost")
    )


@query(f"SELECT count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM ({CELLS}) WHERE x BETWEEN 4 AND 19 AND y BETWEEN 0 AND 15 AND z BETWEEN 8 AND 27")
def box_query(spark, sf_dir):
    return topology.bounding_box(tables.cells(spark, sf_dir), (4, 0, 8), (19, 15, 27)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH s AS (SELECT x, y, z, count(*) AS k FROM ({CELLS}) GROUP BY x, y, z) SELECT q.id, o.hop, count(*)::BIGINT AS cells, sum(s.k)::BIGINT AS n FROM (SELECT id, x & 31 AS x, y & 31 AS y, z & 31 AS z FROM ({SIGNED}) WHERE id % 10 = 0) q, {_ring(2)}, s WHERE s.x = q.x + a AND s.y = q.y + b AND s.z = q.z + c GROUP BY 1, 2")
def ring_density(spark, sf_dir):
    """Cells and rows by hop around query points (every tenth customer is a query)."""
    wrap = [F.col(c).bitwiseAND(F.lit(31).cast("long")).alias(c) for c in XYZ]
    asked = tables.signed_cells(spark, sf_dir).filter("id % 10 = 0").select("id", *wrap)
    held = tables.cells(spark, sf_dir).groupBy(*[F.col(c).alias(f"o{c}") for c in XYZ]).agg(F.count("*").alias("k"))
    return topology.ring(asked, 2).join(held, ["ox", "oy", "oz"]).groupBy("id", "hop").agg(F.count("*").alias("cells"), F.sum("k").alias("n"))


@query(f"SELECT id, x + a AS ox, y + b AS oy, z + c AS oz FROM ({SIGNED}), {_ring(4)} WHERE a * a + b * b + c * c <= 12.25")
def radius_cells(spark, sf_dir):
    return topology.radius(tables.signed_cells(spark, sf_dir), 3.5).select("id", "ox", "oy", "oz")


_ROUNDED = ", ".join(f"round({c} / 2)::BIGINT * 2 AS e{c}, round(({c} - 1) / 2)::BIGINT * 2 + 1 AS u{c}" for c in XYZ)
_FAR = {k: " + ".join(f"({k}{c} - {c}) * ({k}{c} - {c})" for c in XYZ) for k in "eu"}
_NEAREST = ", ".join(f"CASE WHEN {_FAR['e']} <= {_FAR['u']} THEN e{c} ELSE u{c} END AS {c}" for c in XYZ)


@query(
    "WITH r AS (SELECT id, x, y, z, greatest(abs(x), abs(y), abs(z)) * 2 AS far FROM (" + SIGNED + ")), "
    "i AS (SELECT id, x, y, z, unnest(range(greatest(far, 1) + 1)) AS i, greatest(far, 1) AS steps FROM r), "
    "p AS (SELECT id, i, x + (0 - x) * (i / steps) AS x, y + (0 - y) * (i / steps) AS y, z + (0 - z) * (i / steps) AS z FROM i), "
    f"q AS (SELECT id, i, {_NEAREST} FROM (SELECT id, i, x, y, z, {_ROUNDED} FROM p)), "
    "every AS (SELECT * FROM q UNION ALL SELECT id, greatest(far, 1) + 1, 0, 0, 0 FROM r), "
    "b AS (SELECT id, i, x || ' ' || y || ' ' || z AS p, lag(x || ' ' || y || ' ' || z) OVER (PARTITION BY id ORDER BY i) AS before FROM every) "
    "SELECT id, count(*)::INT AS n, list(p ORDER BY i) AS points FROM b WHERE p IS DISTINCT FROM before GROUP BY id"
)
def lines(spark, sf_dir):
    rows = topology.trace_lines(tables.signed_cells(spark, sf_dir), col(*XYZ), [F.lit(0).cast("long")] * 3)
    line = F.col("line")
    return rows.select("id", F.size(line).alias("n"), F.transform(line, lambda p: F.concat_ws(" ", p["x"], p["y"], p["z"])).alias("points"))


#: A smaller world for searches: all line items in cells of 0 to 15.
ROOMS = _snap("l_partkey % 16", "l_suppkey % 16", "(l_orderkey + l_linenumber) % 16", "lineitem")


def _free(spark, sf_dir):
    return tables.cells(spark, sf_dir, 16).select(*XYZ).distinct()


@query(
    f"WITH RECURSIVE f AS (SELECT x, y, z, {_morton()} AS key FROM (SELECT DISTINCT x, y, z FROM ({ROOMS}))), "
    f"starts AS (SELECT id, x, y, z, {_morton()} AS key FROM (VALUES (1, 0, 0, 0), (2, 14, 14, 14)) v(id, x, y, z)), "
    "cells AS (SELECT x, y, z, key FROM f UNION SELECT x, y, z, key FROM starts), "
    f"edges AS (SELECT p.key AS a, q.key AS b, CASE WHEN n.a & 1 = 1 THEN sqrt(3.0::DOUBLE) ELSE 2.0::DOUBLE END AS cost FROM cells p, {_NEIGHBORS}, f q WHERE q.x = p.x + n.a AND q.y = p.y + n.b AND q.z = p.z + n.c), "
    "best(id, key, cost) USING KEY (id, key) AS (SELECT id, cells.key, CASE WHEN cells.key = starts.key THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END FROM starts, cells "
    "UNION SELECT l.id, e.b, min(l.cost + e.cost) FROM best l JOIN edges e ON l.key = e.a JOIN recurring.best r ON r.id = l.id AND r.key = e.b WHERE l.cost + e.cost < r.cost - 1e-12 GROUP BY l.id, e.b) "
    "SELECT id::BIGINT AS id, x, y, z, round(cost, 6) AS cost FROM best JOIN cells USING (key) WHERE isfinite(cost)"
)
def blocked_paths(spark, sf_dir):
    """Least costs from two corners through the cells that are there."""
    starts = spark.createDataFrame([(1, 0, 0, 0), (2, 14, 14, 14)], "id long, x long, y long, z long")
    return topology.shortest_paths(_free(spark, sf_dir), starts).select("id", *XYZ, r6(F.col("cost"), "cost"))


@query()
def maze(spark, sf_dir):
    """A spanning tree over neighbouring cells."""
    cells = _free(spark, sf_dir).withColumn("key", ids.morton(*col(*XYZ)))
    edges = topology.with_neighbor_values(cells, "key").select(F.col("key").alias("a"), F.col("n_value").alias("b"))
    return topology.spanning_tree(edges, 7)


# Layers. --------------------------------------------------------------------------------------------------------------


@query(f"SELECT {_STATS} FROM ({CELLS}) WHERE x < 8")
def aggregate_cells(spark, sf_dir):
    layer = tables.cells(spark, sf_dir)
    wanted = layer.filter("x < 8").select(*XYZ).distinct()
    out = layers.aggregate(wanted, layer)
    return out.select("count", F.round("sum", 4).alias("sum"), r6(F.col("mean"), "mean"), "min", "max", r6(F.col("median"), "median"))


def _rollup_sql(source: str, levels: int) -> str:
    for _ in range(levels):
        source = f"SELECT {', '.join(f'p{c} AS {c}' for c in XYZ)}, value FROM (SELECT value, {_PARENT} FROM ({source}))"
    return f"SELECT x, y, z, count(*)::BIGINT AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median FROM ({source}) GROUP BY x, y, z"


def _rolled(spark, sf_dir, levels):
    out = layers.rollup(tables.cells(spark, sf_dir), levels=levels)
    return out.select(*XYZ, "count", F.round("sum", 4).alias("sum"), r6(F.col("mean"), "mean"), "min", "max", r6(F.col("median"), "median"))


@query(_rollup_sql(CELLS, 1))
def rollup_one(spark, sf_dir):
    return _rolled(spark, sf_dir, 1)


@query(_rollup_sql(CELLS, 3))
def rollup_three(spark, sf_dir):
    return _rolled(spark, sf_dir, 3)


@query(f"SELECT x, y, z, arg_max(confidence, (ts, seq)) AS value FROM ({OBS}) GROUP BY x, y, z")
def upserted(spark, sf_dir):
    rows = tables.observations(spark, sf_dir).withColumn("order", F.struct("ts", "seq"))
    return layers.upsert(rows, "order", "confidence").withColumnRenamed("confidence", "value")


_LOGIT = "ln(greatest(0.001, least(0.999, confidence)) / (1 - greatest(0.001, least(0.999, confidence))))"
_FOLD = f"SELECT x, y, z, list_reduce(list(CASE WHEN occupied THEN {_LOGIT} ELSE -{_LOGIT} END ORDER BY ts, seq), lambda a, d: greatest(-3.5, least(3.5, a + d)), 0.0::DOUBLE) AS l, count(*)::BIGINT AS n FROM ({OBS}) GROUP BY x, y, z"
_STATE = "CASE WHEN l > 0.85 THEN 'Occupied' WHEN l < -0.85 THEN 'Free' ELSE 'Unknown' END"


def _occupancy(spark, sf_dir):
    return layers.occupancy(tables.observations(spark, sf_dir))


@query(f"SELECT x, y, z, round(l, 6) AS l, n, {_STATE} AS state, round(1 / (1 + exp(-l)), 6) AS p FROM ({_FOLD})")
def occupancy_layer(spark, sf_dir):
    l = F.col("l")
    return _occupancy(spark, sf_dir).select(*XYZ, r6(l, "l"), "n", layers.state(l).alias("state"), r6(layers.probability(l), "p"))


@query(f"SELECT count(*)::BIGINT AS total, count(*) FILTER (l > 0.85)::BIGINT AS occupied, count(*) FILTER (l < -0.85)::BIGINT AS free, count(*) FILTER (l BETWEEN -0.85 AND 0.85)::BIGINT AS unknown, sum(n)::BIGINT AS measurements FROM ({_FOLD})")
def occupancy_totals(spark, sf_dir):
    return layers.occupancy_stats(_occupancy(spark, sf_dir))


_TLOGIT = "ln(confidence / (1 - confidence))"
_TFOLD = (
    f"SELECT x, y, z, list_reduce(list({{'l': CASE WHEN occupied THEN {_TLOGIT} ELSE -{_TLOGIT} END, 't': epoch_us(ts) / 1000000.0::DOUBLE}} ORDER BY ts, seq), "
    "lambda s, r: {'l': greatest(-3.466, least(3.466, s.l * CASE WHEN s.t IS NULL THEN 1.0 ELSE exp(-0.00001 * (r.t - s.t)) END + r.l)), 't': r.t}, {'l': 0.0::DOUBLE, 't': NULL::DOUBLE}) AS s, count(*)::BIGINT AS n "
    f"FROM ({OBS}) GROUP BY x, y, z"
)


@query(
    f"SELECT x, y, z, n, round(s.l * exp(-0.00001 * (b.e - s.t)), 6) AS l, (b.e - s.t > 86400) AS stale, CASE WHEN b.e - s.t > 86400 THEN 'Unknown' WHEN s.l * exp(-0.00001 * (b.e - s.t)) > 0.847 THEN 'Occupied' WHEN s.l * exp(-0.00001 * (b.e - s.t)) < -1.099 THEN 'Free' ELSE 'Unknown' END AS state "
    f"FROM ({_TFOLD}), (SELECT max(epoch_us(ts) / 1000000.0::DOUBLE) AS e FROM events) b"
)
def temporal_layer(spark, sf_dir):
    layer = layers.temporal(tables.observations(spark, sf_dir), 1e-5)
    end = tables.read(spark, sf_dir, "events").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("e"))
    out = layers.temporal_state(layer.crossJoin(F.broadcast(end)), F.col("e"), 1e-5, 86400.0)  # one row
    return out.select(*XYZ, "n", r6(F.col("l"), "l"), "stale", "state")


_BFOLD = f"SELECT x, y, z, list_reduce(list(CASE WHEN occupied THEN {_TLOGIT} ELSE -{_TLOGIT} END ORDER BY ts, seq), lambda a, d: greatest(-3.466, least(3.466, a + d)), 0.0::DOUBLE) AS l, count(*)::BIGINT AS n FROM ({OBS}) GROUP BY x, y, z"


@query(f"SELECT x // 8 AS bx, y // 8 AS by, z // 8 AS bz, count(*)::BIGINT AS n, round(sum(l), 5) AS total, 512 AS size FROM ({_BFOLD}) GROUP BY 1, 2, 3")
def dense_blocks(spark, sf_dir):
    b = layers.block_occupancy(tables.observations(spark, sf_dir))
    return b.select("bx", "by", "bz", "n", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 5).alias("total"), F.size("values").alias("size"))


@query(
    f"WITH r AS (SELECT x, y, ts, seq, occupied, coalesce(occupied <> lag(occupied) OVER (PARTITION BY x, y ORDER BY ts, seq), true)::INT AS new FROM ({OBS})), "
    "g AS (SELECT *, sum(new) OVER (PARTITION BY x, y ORDER BY ts, seq) AS run FROM r) SELECT x, y, run::BIGINT AS run, any_value(occupied) AS occupied, count(*)::BIGINT AS length FROM g GROUP BY x, y, run"
)
def runs(spark, sf_dir):
    rows = tables.observations(spark, sf_dir).withColumn("order", F.struct("ts", "seq"))
    return layers.run_lengths(rows, ["x", "y"], "order", "occupied")


@query(
    "WITH r AS (SELECT id AS ray, x + 8 AS ex, y + 8 AS ey, z + 8 AS ez FROM (" + POINTS + ")), "
    "d AS (SELECT *, sqrt((ex - 10) * (ex - 10) + (ey - 10) * (ey - 10) + (ez - 10) * (ez - 10)) AS far FROM r), "
    "s AS (SELECT *, unnest(range(floor(far / 0.25)::BIGINT)) AS step FROM d WHERE far >= 0.000001), "
    "hits AS (SELECT ray, step, 10 + (ex - 10) / far * (step * 0.25) AS x, 10 + (ey - 10) / far * (step * 0.25) AS y, 10 + (ez - 10) / far * (step * 0.25) AS z, 0.7::DOUBLE AS confidence, false AS occupied FROM s "
    "UNION ALL SELECT ray, floor(far / 0.25)::BIGINT, ex, ey, ez, 0.9::DOUBLE, true FROM d WHERE far >= 0.000001), "
    f"v AS ({_snap('round(x / 0.5)', 'round(y / 0.5)', 'round(z / 0.5)', 'hits', 'ray AS ray ; step AS step ; confidence AS confidence ; occupied AS occupied')}) "
    f"SELECT x, y, z, round(list_reduce(list(CASE WHEN occupied THEN {_LOGIT} ELSE -{_LOGIT} END ORDER BY ray, step), lambda a, d: greatest(-3.5, least(3.5, a + d)), 0.0::DOUBLE), 6) AS l, count(*)::BIGINT AS n "
    "FROM v WHERE x BETWEEN 0 AND 65535 AND y BETWEEN 0 AND 65535 AND z BETWEEN 0 AND 65535 GROUP BY x, y, z"
)
def rays(spark, sf_dir):
    """Voxels that rays from a corner to the points pass, with their evidence."""
    p = tables.points(spark, sf_dir)
    r = p.select(F.col("id").alias("ray"), *[F.lit(10.0).alias(f"s{c}") for c in XYZ], *[(F.col(c) + 8.0).alias(f"e{c}") for c in XYZ])
    hits = layers.integrate_rays(r, 0.5, 0.7, 0.9)
    # A free step is evidence against: its probability counts as that of being free.
    rows = hits.withColumn("ts", F.timestamp_seconds(F.col("ray"))).withColumn("seq", F.col("step"))
    return layers.occupancy(rows).select(*XYZ, r6(F.col("l"), "l"), "n")


_TSDF = (
    f"SELECT x, y, z, list_reduce(list({{'d': sdf, 'w': 1.0::DOUBLE}} ORDER BY seq.a, seq.b, seq.c, seq.d, seq.e), lambda s, r: {{'d': CASE WHEN s.w = 0 THEN r.d ELSE (s.d * s.w + r.d) / least(s.w + 1.0, 100.0) END, 'w': least(s.w + 1.0, 100.0)}}, {{'d': 0.0::DOUBLE, 'w': 0.0::DOUBLE}}) AS s, count(*)::BIGINT AS n "
    f"FROM ({SDF}) WHERE abs(sdf) <= 0.1 GROUP BY x, y, z"
)
_T = f"SELECT x, y, z, round(s.d, 9) AS d, s.w AS w, n FROM ({_TSDF})"


def _tsdf(spark, sf_dir):
    """Rounded, so that signs don't hang on the last bit."""
    return layers.tsdf(tables.distances(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query(f"SELECT x, y, z, round(d, 6) AS distance, w, n FROM ({_T})")
def tsdf_layer(spark, sf_dir):
    return _tsdf(spark, sf_dir).select(*XYZ, r6(F.col("distance"), "distance"), "w", "n")


@query(f"SELECT count(*)::BIGINT AS total, round(min(d), 6) AS least, round(max(d), 6) AS most, count(*) FILTER (abs(d) < 0.02)::BIGINT AS surface, round(avg(w), 6) AS mean_weight FROM ({_T})")
def tsdf_totals(spark, sf_dir):
    s = layers.tsdf_stats(_tsdf(spark, sf_dir))
    return s.select("total", r6(F.col("least"), "least"), r6(F.col("most"), "most"), "surface", r6(F.col("mean_weight"), "mean_weight"))


_EDGES = (
    f"WITH t AS ({_T}) SELECT p.x, p.y, p.z, q.x AS nx, q.y AS ny, q.z AS nz, CASE WHEN abs(q.d - p.d) > 0.000001 THEN greatest(0, least(1, -p.d / (q.d - p.d))) ELSE 0.5 END AS t FROM t p, {_NEIGHBORS}, t q "
    f"WHERE q.x = p.x + a AND q.y = p.y + b AND q.z = p.z + c AND p.d * q.d < 0 AND {_morton('p.x', 'p.y', 'p.z')} < {_morton('q.x', 'q.y', 'q.z')}"
)


@query(f"SELECT x, y, z, nx, ny, nz, round((x + t * (nx - x)) * 0.02, 6) AS vx, round((y + t * (ny - y)) * 0.02, 6) AS vy, round((z + t * (nz - z)) * 0.02, 6) AS vz FROM ({_EDGES})")
def mesh_points(spark, sf_dir):
    v = layers.mesh_vertices(_tsdf(spark, sf_dir), 0.02)
    return v.select(*XYZ, "nx", "ny", "nz", *[r6(F.col(f"v{c}"), f"v{c}") for c in XYZ])


@query(
    "WITH v AS (SELECT {'x': x, 'y': y, 'z': z, 'nx': nx, 'ny': ny, 'nz': nz} AS e, (x + t * (nx - x)) * 0.02 AS vx, (y + t * (ny - y)) * 0.02 AS vy, (z + t * (nz - z)) * 0.02 AS vz "
    f"FROM ({_EDGES})), "
    "ends AS (SELECT e.x AS x, e.y AS y, e.z AS z, e FROM v UNION ALL SELECT e.nx, e.ny, e.nz, e FROM v), "
    "f AS (SELECT DISTINCT a.e AS a, b.e AS b, c.e AS c FROM ends a JOIN ends b USING (x, y, z) JOIN ends c USING (x, y, z) WHERE a.e < b.e AND b.e < c.e), "
    "d AS (SELECT b.vx - a.vx AS ux, b.vy - a.vy AS uy, b.vz - a.vz AS uz, c.vx - a.vx AS wx, c.vy - a.vy AS wy, c.vz - a.vz AS wz FROM f JOIN v a ON f.a = a.e JOIN v b ON f.b = b.e JOIN v c ON f.c = c.e) "
    "SELECT count(*)::BIGINT AS triangles, round(sum(0.5 * sqrt(pow(uy * wz - uz * wy, 2) + pow(uz * wx - ux * wz, 2) + pow(ux * wy - uy * wx, 2))), 4) AS area FROM d"
)
def mesh_faces(spark, sf_dir):
    from ..operators.topology import shared

    v = shared(layers.mesh_vertices(_tsdf(spark, sf_dir), 0.02), "vertices")
    out = layers.surface_area(layers.mesh_triangles(v), v)
    return out.select("triangles", F.round("area", 4).alias("area"))


_G = [f"avg((q.d - p.d) * {o})" for o in "abc"]


@query(f"WITH t AS ({_T}), g AS (SELECT p.x, p.y, p.z, {_G[0]} AS gx, {_G[1]} AS gy, {_G[2]} AS gz FROM t p, {_NEIGHBORS}, t q WHERE q.x = p.x + a AND q.y = p.y + b AND q.z = p.z + c GROUP BY 1, 2, 3), m AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS m FROM g) SELECT x, y, z, round(gx / m, 4) AS gx, round(gy / m, 4) AS gy, round(gz / m, 4) AS gz FROM m WHERE m > 0.000001")
def gradients(spark, sf_dir):
    g = layers.gradient(_tsdf(spark, sf_dir))
    return g.select(*XYZ, *[F.round(f"g{c}", 4).alias(f"g{c}") for c in XYZ])


_AXIS = "(SELECT unnest(range(-10, 11)) AS {0})"
_ESDF = (
    f"WITH near AS (SELECT x, y, z, d AS own FROM ({_T}) WHERE abs(d) < 0.005 AND w > 0), "
    f"o AS (SELECT a, b, c, list_sort([abs(a), abs(b), abs(c)]) AS s FROM {_AXIS.format('a')}, {_AXIS.format('b')}, {_AXIS.format('c')} WHERE (a & 1) = (b & 1) AND (b & 1) = (c & 1)), "
    "cost AS (SELECT a, b, c, (sqrt(3.0::DOUBLE) * s[2] + (s[3] - s[2])) * 0.05::DOUBLE AS way FROM o), "
    "spread AS (SELECT x + a AS x, y + b AS y, z + c AS z, own, way FROM near, cost WHERE way <= 0.4 AND x + a >= 0 AND y + b >= 0 AND z + c >= 0), "
    "best AS (SELECT x, y, z, min(abs(own) + way) AS m, arg_min(CASE WHEN own < 0 THEN -1 ELSE 1 END, {'m': abs(own) + way, 's': CASE WHEN own < 0 THEN -1 ELSE 1 END}) AS sign, min(own) FILTER (way = 0) AS own FROM spread GROUP BY x, y, z), "
    "sources AS (SELECT x, y, z FROM best WHERE m <= 0.3 - sqrt(3.0::DOUBLE) * 0.05 OR own IS NOT NULL), "
    f"domain AS (SELECT x, y, z FROM sources UNION SELECT x + a, y + b, z + c FROM sources, {_NEIGHBORS}) "
    "SELECT x, y, z, coalesce(own, sign * least(m, 0.3::DOUBLE)) AS distance FROM best SEMI JOIN domain USING (x, y, z)"
)


@query(
    f"SELECT x, y, z, round(distance, 6) AS distance FROM ({_ESDF})"
)
def esdf_layer(spark, sf_dir):
    e = layers.esdf(_tsdf(spark, sf_dir), 0.05, 0.3, 0.005)
    return e.select(*XYZ, r6(F.col("distance"), "distance"))


@query(
    f"SELECT count(*)::BIGINT AS total, count_if(distance < 0)::BIGINT AS inside, count_if(distance >= 0)::BIGINT AS outside, round(min(distance), 6) AS least, round(max(distance), 6) AS most FROM ({_ESDF})"
)
def esdf_totals(spark, sf_dir):
    s = layers.esdf_stats(layers.esdf(_tsdf(spark, sf_dir), 0.05, 0.3, 0.005))
    return s.select("total", "inside", "outside", r6(F.col("least"), "least"), r6(F.col("most"), "most"))


@query(
    f"WITH k AS (SELECT x, y, z, {_STATE} AS s FROM ({_FOLD})), f AS (SELECT DISTINCT x + a AS x, y + b AS y, z + c AS z FROM k, {_NEIGHBORS} WHERE s = 'Free' AND x + a >= 0 AND y + b >= 0 AND z + c >= 0) "
    "SELECT f.x, f.y, f.z FROM f ANTI JOIN (SELECT * FROM k WHERE s <> 'Unknown') w ON f.x = w.x AND f.y = w.y AND f.z = w.z"
)
def frontier_cells(spark, sf_dir):
    return layers.frontier_voxels(_occupancy(spark, sf_dir))


@query(
    f"WITH RECURSIVE k AS (SELECT x, y, z, {_STATE} AS s FROM ({_FOLD})), g AS (SELECT DISTINCT x + a AS x, y + b AS y, z + c AS z FROM k, {_NEIGHBORS} WHERE s = 'Free' AND x + a >= 0 AND y + b >= 0 AND z + c >= 0), "
    f"f AS (SELECT x, y, z, {_morton()} AS key FROM g ANTI JOIN (SELECT * FROM k WHERE s <> 'Unknown') w USING (x, y, z)), "
    f"links AS (SELECT p.key AS a, q.key AS b FROM f p, {_NEIGHBORS}, f q WHERE q.x = p.x + n.a AND q.y = p.y + n.b AND q.z = p.z + n.c), "
    "least_(key, cluster) USING KEY (key) AS (SELECT key, key FROM f UNION SELECT links.b, min(l.cluster) FROM least_ l JOIN links ON l.key = links.a JOIN recurring.least_ r ON r.key = links.b WHERE l.cluster < r.cluster GROUP BY links.b) "
    "SELECT cluster, count(*)::BIGINT AS n, count(*)::DOUBLE AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, min(x)::DOUBLE AS low_x, min(y)::DOUBLE AS low_y, min(z)::DOUBLE AS low_z, max(x)::DOUBLE AS high_x, max(y)::DOUBLE AS high_y, max(z)::DOUBLE AS high_z "
    "FROM f JOIN least_ USING (key) GROUP BY cluster HAVING count(*) >= 5"
)
def frontier_clusters(spark, sf_dir):
    c = layers.frontiers(_occupancy(spark, sf_dir))
    return c.select("cluster", "n", "area", *[r6(F.col(f"c{a}"), f"c{a}") for a in XYZ], *[F.col(f"{e}_{a}") for e in ("low", "high") for a in XYZ]).orderBy(F.desc("n"), "cluster")


@query(
    f"WITH o AS (SELECT x, y, z, l FROM ({_FOLD})), t AS ({_T}) SELECT v.x, v.y, v.z, round(o.l, 6) AS occupancy_l, round(t.d, 6) AS tsdf_distance FROM (SELECT DISTINCT x, y, z FROM ({CELLS})) v "
    "LEFT JOIN o ON o.x = v.x AND o.y = v.y AND o.z = v.z LEFT JOIN t ON t.x = v.x AND t.y = v.y AND t.z = v.z"
)
def layered_map(spark, sf_dir):
    m = layers.LayeredMap()
    m.add("occupancy", _occupancy(spark, sf_dir).select(*XYZ, r6(F.col("l"), "l")))
    m.add("tsdf", _tsdf(spark, sf_dir).select(*XYZ, r6(F.col("distance"), "distance")))
    return m.query(tables.cells(spark, sf_dir).select(*XYZ).distinct())


@query(f"SELECT x, y, CAST(max(round(100 / (1 + exp(-l)))) AS INT) AS value FROM ({_FOLD}) GROUP BY x, y")
def flat_map(spark, sf_dir):
    """An occupancy grid seen from above: the most in each column, 0 to 100."""
    return files.occupancy_grid(_occupancy(spark, sf_dir))
