"""Queries on keys: neighbours as keys, cells of 128 bits, validation, edges of the ranges, grids and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, lattice
from ..operators import topology
from ..operators.topology import XYZ
from ..runtime import spread
from ..sources import tables
from .catalogue import _MIN, _NEIGHBORS, _PARENT, CELLS, POINTS, ROOMS, SIGNED, _free, _morton, _nearest, _ring, col, query, r6

# Rows near the edges of a range: every fourth at the upper, every fourth at the lower end.


def _edge_sql(up: int, down: int) -> str:
    shift = f"CASE id % 4 WHEN 0 THEN {up} WHEN 1 THEN {down} ELSE 0 END"
    return f"(SELECT id, x + {shift} AS x, y + {shift} AS y, z + {shift} AS z FROM ({SIGNED}))"


def _edge(spark, sf_dir, up: int, down: int):
    shift = F.when(F.col("id") % 4 == 0, up).when(F.col("id") % 4 == 1, down).otherwise(0)
    return tables.signed_cells(spark, sf_dir).select("id", *[(F.col(c) + shift).cast("long").alias(c) for c in XYZ])


def _within(low: int, high: int) -> str:
    return " AND ".join(f"{c} BETWEEN {low} AND {high}" for c in ("x + a", "y + b", "z + c"))


def _route(x: str, y: str, z: str) -> str:
    return f"(4611686018427387904 + ((({x}) & 1048575) << 40) + ((({y}) & 1048575) << 20) + (({z}) & 1048575))::BIGINT"


_HALF_ROUTE = _edge_sql(524188, -524188)


@query(f"SELECT id, list({_route('x + a', 'y + b', 'z + c')} ORDER BY slot) AS around FROM {_HALF_ROUTE}, {_NEIGHBORS} WHERE {_within(-524288, 524287)} GROUP BY id")
def route_neighbors(spark, sf_dir):
    rows = spread(_edge(spark, sf_dir, 524188, -524188)).select("id", ids.route64(F.lit(0), *col(*XYZ)).alias("k"))
    return rows.select("id", ids.route_neighbors(F.col("k")).alias("around"))


_UPPER = f"(SELECT id, x + 100 + CASE WHEN id % 3 = 0 THEN 65336 ELSE 0 END AS x, y + 100 + CASE WHEN id % 3 = 0 THEN 65336 ELSE 0 END AS y, z + 100 AS z FROM ({SIGNED}))"


@query(f"SELECT id, list({_MIN} + ((2::BIGINT << 60) | (9::BIGINT << 52) | (7::BIGINT << 48) | {_morton('x + a', 'y + b', 'z + c')}) ORDER BY slot) AS around FROM {_UPPER}, {_NEIGHBORS} WHERE {_within(0, 65535)} GROUP BY id")
def index_neighbors(spark, sf_dir):
    far = F.when(F.col("id") % 3 == 0, 65336).otherwise(0)
    rows = tables.signed_cells(spark, sf_dir).select("id", *[(F.col(c) + 100 + (far if c != "z" else 0)).cast("long").alias(c) for c in XYZ])
    rows = spread(rows).select("id", ids.index64(F.lit(9), F.lit(2), F.lit(7), *col(*XYZ), strict=True).alias("k"))
    return rows.select("id", ids.index_neighbors(F.col("k")).alias("around"))


_WORD = "({0} & 4294967295)"
_GHI = "((5::BIGINT << 56) | (1::BIGINT << 54) | (10::BIGINT << 48) | (2::BIGINT << 40) | (1::BIGINT << 36) | (3::BIGINT << 32) | " + _WORD + ")"


def _lo(y: str, z: str) -> str:
    return f"(({y}) * 4294967296 + ({_WORD.format('(' + z + ')')}))"


_HALF_INT = _edge_sql(2147483548, -2147483548)


@query(f"SELECT id, list({_GHI.format('(x + a)')} || ':' || {_lo('y + b', 'z + c')} ORDER BY slot) AS around FROM {_HALF_INT}, {_NEIGHBORS} WHERE {_within(-2147483648, 2147483647)} GROUP BY id")
def galactic_neighbors(spark, sf_dir):
    lit = F.lit
    rows = spread(_edge(spark, sf_dir, 2147483548, -2147483548)).withColumn("g", ids.galactic128(lit(2), lit(5), lit(1), lit(10), lit(3), *col(*XYZ)))
    return rows.select("id", F.transform(ids.galactic_neighbors(F.col("g")), lambda n: F.concat_ws(":", n["hi"], n["lo"])).alias("around"))


@query(f"SELECT id, 5::BIGINT AS mant, 1::BIGINT AS tier, 10::BIGINT AS lod, 2::BIGINT AS frame, 3::BIGINT AS user_, 1::BIGINT AS version, x AS gx, y AS gy, z AS gz, id % 2 = 0 AS valid, 'G128(f=2, t=1:5, lod=10, ' || x || ',' || y || ',' || z || ')' AS shown, {_route('x', 'y', 'z')} AS route FROM ({SIGNED})")
def galactic_fields(spark, sf_dir):
    """All fields; of keys whose version is another one for odd rows. With an Index64 turned into a Route64 beside it."""
    lit = F.lit
    rows = tables.signed_cells(spark, sf_dir).withColumn("g", ids.galactic128(lit(2), lit(5), lit(1), lit(10), lit(3), *col(*XYZ)))
    f = ids.galactic_fields(F.col("g"))
    broken = F.struct((F.col("g.hi") + F.when(F.col("id") % 2 == 1, 1 << 36).otherwise(0)).alias("hi"), F.col("g.lo").alias("lo"))
    return rows.select(
        "id", *[f[n].alias(n) for n in ("mant", "tier", "lod", "frame")], f["user"].alias("user_"), f["version"].alias("version"), *[f[c].alias(f"g{c}") for c in XYZ],
        ids.galactic_valid(broken).alias("valid"), ids.display_galactic(F.col("g")).alias("shown"), ids.route64(lit(0), *col(*XYZ)).alias("route"),
    )


@query(f"SELECT id, k AS key, (id % 4 = 2) AS is_index, CASE WHEN id % 4 = 2 THEN {_route('x', 'y', 'z')} + (1::BIGINT << 60) END AS route FROM (SELECT *, ((id % 4) << 62) | (1::BIGINT << 60) | (5::BIGINT << 48) | {_morton()} AS k FROM (SELECT id, x + 100 AS x, y + 100 AS y, z + 100 AS z FROM ({SIGNED})))".replace("((id % 4) << 62)", "(CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 4611686018427387904 WHEN 2 THEN " + _MIN + " ELSE (-4611686018427387904)::BIGINT END)"))
def key_headers(spark, sf_dir):
    """Numbers with each of the four headers: which are Index64, and their Route64."""
    rows = tables.signed_cells(spark, sf_dir).select("id", *[(F.col(c) + 100).alias(c) for c in XYZ])
    head = F.when(F.col("id") % 4 == 0, F.lit(0)).when(F.col("id") % 4 == 1, F.lit(1 << 62)).when(F.col("id") % 4 == 2, F.lit(-(1 << 63))).otherwise(F.lit(-(1 << 62))).cast("long")
    key = head.bitwiseOR(F.lit((1 << 60) | (5 << 48)).cast("long")).bitwiseOR(ids.morton(*col(*XYZ)))
    rows = rows.withColumn("key", key)
    good = ids.index_valid(F.col("key"))
    return rows.select("id", "key", good.alias("is_index"), F.when(good, ids.index_to_route(F.col("key"))).alias("route"))


_CHI = "(" + _WORD.format("({0})") + " + ({1}) * 4294967296)"


def _cell_sql(resolution: str, x: str, y: str, z: str) -> str:
    return f"({_CHI.format(y, z)} || ':' || ((({resolution}) << 8) + 3 + ({x}) * 4294967296))"


@query(f"SELECT id, id % 256 AS resolution, CASE WHEN id % 256 > 0 THEN {_cell_sql('id % 256 - 1', 'px', 'py', 'pz')} END AS up, CASE WHEN id % 256 < 255 THEN 8 ELSE -1 END AS n, CASE WHEN id % 256 < 255 THEN {_cell_sql('id % 256 + 1', '2 * x', '2 * y', '2 * z')} END AS first_child, 'CellID(frame=3, res=' || id % 256 || ', x=' || x || ', y=' || y || ', z=' || z || ')' AS shown FROM (SELECT id, x, y, z, {_PARENT} FROM ({SIGNED}))")
def cell_hierarchy(spark, sf_dir):
    """Parents and children of 128-bit cells; those of resolution 0 and 255 have none. Exponent and flags don't stay."""
    r = F.col("id") % 256
    rows = tables.signed_cells(spark, sf_dir).withColumn("c", ids.cell_id(F.lit(3), r, F.lit(2), F.lit(5), *col(*XYZ)))
    up, down = ids.cell_parent(F.col("c")), ids.cell_children(F.col("c"))
    shown = lambda c: F.when(c.isNotNull(), F.concat_ws(":", c["hi"], c["lo"]))
    n = F.coalesce(F.size(down), F.lit(-1))
    return rows.select("id", r.alias("resolution"), shown(up).alias("up"), n.alias("n"), shown(F.get(down, F.lit(0))).alias("first_child"), ids.display_cell(F.col("c")).alias("shown"))


@query(f"SELECT id, list({_cell_sql('7', 'x + a', 'y + b', 'z + c')} ORDER BY slot) AS around FROM ({SIGNED}), {_NEIGHBORS} GROUP BY id")
def cell_neighbors(spark, sf_dir):
    rows = tables.signed_cells(spark, sf_dir).withColumn("c", ids.cell_id(F.lit(3), F.lit(7), F.lit(2), F.lit(5), *col(*XYZ)))
    return rows.select("id", F.transform(ids.cell_neighbors(F.col("c")), lambda n: F.concat_ws(":", n["hi"], n["lo"])).alias("around"))


_LEVELS = f"(SELECT DISTINCT x, y, z, {_morton()} AS m, (x % 3) * 7 + (x % 3) // 2 AS lod FROM ({CELLS}))"
_G = f"xor(m, (m >> 1) & {0x6DB6DB6DB6DB})"
_HMIN = "(-4611686018427387904)::BIGINT"


def _down(code: str, head: str) -> str:
    return f"list_transform(range(8), lambda i: {head} + (((lod + 1) << 48) | ((({code} << 3) | i) & 281474976710655)))"


@query(
    f"SELECT x, y, z, lod, CASE WHEN lod > 0 THEN {_MIN} + (((lod - 1) << 48) | (m >> 3)) END AS index_up, CASE WHEN lod < 15 THEN {_down('m', _MIN)} ELSE [] END AS index_down, "
    f"CASE WHEN lod > 0 THEN {_HMIN} + (((lod - 1) << 48) | ({_G} >> 3)) END AS hilbert_up, CASE WHEN lod < 15 THEN {_down(_G, _HMIN)} ELSE list_transform(range(8), lambda i: {_HMIN} + ((lod << 48) | {_G})) END AS hilbert_down FROM {_LEVELS}"
)
def key_levels(spark, sf_dir):
    """Parents and children of both kinds of keys at levels 0, 7 and 15."""
    lod = F.col("x") % 3 * 7 + F.floor(F.col("x") % 3 / 2)
    zero = F.lit(0)
    rows = tables.cells(spark, sf_dir).select(*XYZ).distinct().withColumn("m", ids.morton(*col(*XYZ))).withColumn("lod", lod)
    rows = rows.select(*XYZ, "lod", ids.index_of_code(zero, zero, F.col("lod"), F.col("m")).alias("i"), ids.hilbert_of_code(zero, zero, F.col("lod"), F.col("m")).alias("h"))
    i, h = F.col("i"), F.col("h")
    return rows.select(*XYZ, "lod", ids.index_parent(i).alias("index_up"), ids.index_children(i).alias("index_down"), ids.hilbert_parent(h).alias("hilbert_up"), ids.hilbert_children(h).alias("hilbert_down"))


@query("SELECT id, x, y, z, CASE WHEN (x & 1) = (y & 1) AND (y & 1) = (z & 1) THEN x || ' ' || y || ' ' || z END AS point, trunc(x / 2)::BIGINT AS hx, trunc(y / 2)::BIGINT AS hy, trunc(z / 2)::BIGINT AS hz, 3 * x AS tx, 3 * y AS ty, 3 * z AS tz, round(sqrt(0.75::DOUBLE), 6) AS error FROM (SELECT c_custkey AS id, c_custkey % 15 - 7 AS x, c_custkey % 17 - 8 AS y, c_custkey % 19 - 9 AS z FROM customer)")
def checked_points(spark, sf_dir):
    c = F.col("c_custkey").cast("long")
    rows = tables.read(spark, sf_dir, "customer").select(c.alias("id"), (c % 15 - 7).alias("x"), (c % 17 - 8).alias("y"), (c % 19 - 9).alias("z"))
    p = lattice.checked_point(*col(*XYZ))
    named = lambda cs, n: [v.alias(f"{n}{k}") for v, k in zip(cs, XYZ, strict=True)]
    return rows.select("id", *XYZ, F.when(p.isNotNull(), F.concat_ws(" ", p["x"], p["y"], p["z"])).alias("point"), *named(lattice.half(*col(*XYZ)), "h"), *named(lattice.scale(*col(*XYZ), 3), "t"), F.round(F.lit(lattice.MAX_SNAP_ERROR), 6).alias("error"))


@query(f"SELECT id, {_route('cx', 'cy', 'cz')} AS route, round(cx::DOUBLE / 4, 6) AS wx, round(cy::DOUBLE / 4, 6) AS wy, round(cz::DOUBLE / 4, 6) AS wz, round(sqrt(cx * cx + cy * cy + cz * cz) / 4, 6) AS far FROM (SELECT id, {_nearest('4.0')} FROM ({POINTS}))")
def grid_routes(spark, sf_dir):
    """Keys of cells of size 0.5 at points, their centres and how far these are from the origin."""
    grid = lattice.Grid(0.5)
    rows = tables.points(spark, sf_dir).select("id", grid.cell_at(*col(*XYZ)).alias("route"))
    center = grid.center_of(F.col("route"))
    origin = ids.route64(F.lit(0), *[F.lit(0).cast("long")] * 3)
    return rows.select("id", "route", *[r6(c, f"w{n}") for c, n in zip(center, XYZ, strict=True)], r6(grid.distance(F.col("route"), origin), "far"))


@query(f"SELECT id, x + a AS ox, y + b AS oy, z + c AS oz FROM ({SIGNED}), {_ring(3)} WHERE hop = 3 AND id % 5 = 0")
def shell_cells(spark, sf_dir):
    """Cells three steps from query points (every fifth customer is a query)."""
    asked = tables.signed_cells(spark, sf_dir).filter("id % 5 = 0")
    return topology.ring(asked, 3, shell=True).select("id", "ox", "oy", "oz")


# Paths. ---------------------------------------------------------------------------------------------------------------

_DISTINCT = f"SELECT DISTINCT x, y, z FROM ({ROOMS})"
_FREE = f"f AS (SELECT x, y, z, {_morton()} AS key FROM ({_DISTINCT}))"
_FLAGGED = "(x * 3 + y * 5 + z * 7) % 4 = 0"


def _paths_sql(blocked: bool) -> str:
    free = f"SELECT * FROM f WHERE NOT ({_FLAGGED})" if blocked else "SELECT * FROM f"
    return (
        f"WITH RECURSIVE {_FREE}, w AS ({free}), "
        f"asked AS (SELECT id, x, y, z, {_morton()} AS key, {_morton('gx', 'gy', 'gz')} AS goal FROM (VALUES (1, 0, 0, 0, 14, 12, 10), (2, 15, 15, 15, 3, 5, 7), (3, 5, 5, 5, 5, 5, 5), (4, 1, 1, 1, 100, 100, 100)) v(id, x, y, z, gx, gy, gz)), "
        "cells AS (SELECT x, y, z, key FROM w UNION SELECT x, y, z, key FROM asked), "
        f"edges AS (SELECT p.key AS a, q.key AS b, CASE WHEN n.a & 1 = 1 THEN sqrt(3.0::DOUBLE) ELSE 2.0::DOUBLE END AS cost FROM cells p, {_NEIGHBORS}, w q WHERE q.x = p.x + n.a AND q.y = p.y + n.b AND q.z = p.z + n.c), "
        "best(id, key, cost) USING KEY (id, key) AS (SELECT id, cells.key, CASE WHEN cells.key = asked.key THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END FROM asked, cells "
        "UNION SELECT l.id, e.b, min(l.cost + e.cost) FROM best l JOIN edges e ON l.key = e.a JOIN recurring.best r ON r.id = l.id AND r.key = e.b WHERE l.cost + e.cost < r.cost - 1e-12 GROUP BY l.id, e.b) "
        "SELECT asked.id::BIGINT AS id, CASE WHEN isfinite(cost) THEN 'ok' ELSE 'NoPathFound' END AS status, CASE WHEN isfinite(cost) THEN round(cost, 6) END AS cost, true AS valid FROM asked LEFT JOIN best ON best.id = asked.id AND best.key = asked.goal"
    )


_ASKED = [(1, 0, 0, 0, 14, 12, 10), (2, 15, 15, 15, 3, 5, 7), (3, 5, 5, 5, 5, 5, 5), (4, 1, 1, 1, 100, 100, 100)]


def _found(spark, free, cost=None):
    asked = spark.createDataFrame(_ASKED, "id long, x long, y long, z long, gx long, gy long, gz long")
    out = topology.find_paths(free, asked, cost=cost)
    # A path's steps add up to its cost, it begins and ends where it should, and each cell is next to the one before.
    p = F.col("path")
    way = F.aggregate(F.sequence(F.lit(2), F.size(p)), F.lit(0.0), lambda a, i: a + lattice.euclid(*[F.element_at(p, i)[c] - F.element_at(p, i - 1)[c] for c in XYZ]))
    ends = F.element_at(p, 1) == F.struct(*[F.col(c).alias(c) for c in XYZ])
    ends = ends & (F.element_at(p, -1) == F.struct(*[F.col(f"g{c}").alias(c) for c in XYZ]))
    good = F.when(F.size(p) > 1, F.abs(way - F.col("cost")) < 1e-6).otherwise(F.col("cost") == 0) & topology.path_is_valid(p) & ends
    out = out.join(asked, "id")
    return out.select("id", "status", r6(F.col("cost"), "cost"), F.when(p.isNull(), True).otherwise(good).alias("valid"))


@query(_paths_sql(False))
def paths(spark, sf_dir):
    """Ways between pairs of cells through the cells that are there."""
    return _found(spark, _free(spark, sf_dir))


@query(_paths_sql(True))
def paths_around_blocked(spark, sf_dir):
    """The same with a cost that is infinite at blocked cells, told by their flags."""
    flags = F.when((F.col("x") * 3 + F.col("y") * 5 + F.col("z") * 7) % 4 == 0, ids.FLAGS["BLOCKED"]).otherwise(0)
    free = _free(spark, sf_dir).withColumn("flags", flags)
    cost = lambda a, b: F.when(ids.has_flag(F.col("flags"), "BLOCKED"), F.lit(float("inf"))).otherwise(topology.euclidean(a, b))
    return _found(spark, free, cost)


@query(
    f"WITH RECURSIVE {_FREE}, edges AS (SELECT p.key AS a, q.key AS b FROM f p, {_NEIGHBORS}, f q WHERE q.x = p.x + n.a AND q.y = p.y + n.b AND q.z = p.z + n.c), "
    "levels(node, hops) USING KEY (node) AS (SELECT key, CASE WHEN key = (SELECT min(key) FROM f) THEN 0 ELSE 1000000 END FROM f "
    "UNION SELECT e.b, min(l.hops + 1) FROM levels l JOIN edges e ON l.node = e.a JOIN recurring.levels r ON r.node = e.b WHERE l.hops + 1 < r.hops GROUP BY e.b) "
    "SELECT node, hops FROM levels WHERE hops < 1000000"
)
def hops_from_first(spark, sf_dir):
    """Steps from the first cell to all that can be reached."""
    cells = topology.shared(_free(spark, sf_dir).withColumn("key", ids.morton(*col(*XYZ))), "cells")
    edges = topology.with_neighbor_values(cells, "key").select(F.col("key").alias("a"), F.col("n_value").alias("b"))
    return topology.bfs_levels(edges, cells.agg(F.min("key").alias("node")))


_AWAY = ", ".join(f"CASE WHEN {c} <= 7 THEN 15 ELSE 0 END AS k{c}" for c in XYZ)


@query(
    f"WITH p AS (SELECT id, x & 15 AS x, y & 15 AS y, z & 15 AS z FROM ({SIGNED})), k AS (SELECT id, {_AWAY} FROM p), corners AS (SELECT DISTINCT kx, ky, kz FROM k), "
    f"near AS (SELECT kx, ky, kz, min({{'d': (x - kx) * (x - kx) + (y - ky) * (y - ky) + (z - kz) * (z - kz), 'x': x, 'y': y, 'z': z}}) AS s FROM ({_DISTINCT}), corners GROUP BY 1, 2, 3) "
    "SELECT id, s.x AS sx, s.y AS sy, s.z AS sz FROM k JOIN near USING (kx, ky, kz)"
)
def furthest_corners(spark, sf_dir):
    points = tables.signed_cells(spark, sf_dir).select("id", *[F.col(c).bitwiseAND(F.lit(15).cast("long")).alias(c) for c in XYZ])
    return topology.furthest_corner(_free(spark, sf_dir), points, (16, 16, 16))


@query(f"SELECT x, y, z, CASE WHEN x < 10 AND y < 12 THEN (x * 12 + y) * 16 + z END AS number, CASE WHEN x < 10 AND y < 12 THEN x || ' ' || y || ' ' || z END AS back FROM ({_DISTINCT})")
def linear_numbers(spark, sf_dir):
    extent = (10, 12, 16)
    rows = _free(spark, sf_dir).select(*XYZ, lattice.linear_index(*col(*XYZ), extent).alias("number"))
    back = lattice.from_linear_index(F.col("number"), extent)
    return rows.select("*", F.when(F.col("number").isNotNull(), F.concat_ws(" ", *back)).alias("back"))


@query(
    "SELECT count(*)::BIGINT AS games, count_if(m < o)::BIGINT AS wins, count_if(m = o)::BIGINT AS ties, count_if(m > o)::BIGINT AS losses, round(max(o / m * 100), 6) AS best, round(min(o / m * 100), 6) AS worst, round(avg(o / m * 100), 6) AS mean, round((count_if(m <= o))::DOUBLE / count(*) * 100, 6) AS win_rate "
    "FROM (SELECT (user_id % 20 + 5)::DOUBLE AS m, (event_id % 20 + 5)::DOUBLE AS o FROM events)"
)
def score_totals(spark, sf_dir):
    """Totals of scores: moves made against the best number of moves."""
    rows = tables.read(spark, sf_dir, "events").select((F.col("user_id") % 20 + 5).cast("double").alias("m"), (F.col("event_id") % 20 + 5).cast("double").alias("o"))
    m, o, share = F.col("m"), F.col("o"), F.col("o") / F.col("m") * 100
    return rows.agg(F.count("*").alias("games"), F.count_if(m < o).alias("wins"), F.count_if(m == o).alias("ties"), F.count_if(m > o).alias("losses"), r6(F.max(share), "best"), r6(F.min(share), "worst"), r6(F.avg(share), "mean"), r6(F.count_if(m <= o) / F.count("*") * 100, "win_rate"))
