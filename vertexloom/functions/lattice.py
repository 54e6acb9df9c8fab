"""Column functions on points of the body-centred cubic lattice: all three coordinates even, or all three odd."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eight diagonal neighbours, then six axial ones; the order counts.
NEIGHBORS = [
    (1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1), (-1, 1, 1), (-1, 1, -1), (-1, -1, 1), (-1, -1, -1),
    (2, 0, 0), (-2, 0, 0), (0, 2, 0), (0, -2, 0), (0, 0, 2), (0, 0, -2),
]
#: Children of p are 2 p plus these.
CHILDREN = [(0, 0, 0), (2, 0, 0), (0, 2, 0), (0, 0, 2)] + [(1, y, z) for y in (1, -1) for z in (1, -1)]


def point(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def odd(x: Column) -> Column:
    return x.bitwiseAND(1)


def is_valid(x: Column, y: Column, z: Column) -> Column:
    return (odd(x) == odd(y)) & (odd(y) == odd(z))


def scale(x: Column, y: Column, z: Column, by: int) -> tuple[Column, Column, Column]:
    return x * by, y * by, z * by


def half(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Halves cut towards zero; they may be no lattice point, so that hierarchies use parent() instead."""
    return tuple((c / 2).cast("long") for c in (x, y, z))


def opposite(parity: Column) -> Column:
    return 1 - parity


def checked_point(x: Column, y: Column, z: Column, strict: bool = False) -> Column:
    """A point; one of mixed parity is null, or an error if strict."""
    bad = F.raise_error("mixed parity").cast("struct<x:bigint,y:bigint,z:bigint>") if strict else F.lit(None)
    return F.when(is_valid(x, y, z), point(x, y, z)).otherwise(bad)


def snap(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The nearest lattice point of an integer point: the axis whose parity is alone moves by one."""
    most = odd(x) + odd(y) + odd(z) >= 2
    return tuple(F.when((odd(c) == 1) != most, c.bitwiseXOR(1)).otherwise(c) for c in (x, y, z))


def _round(v: Column) -> Column:
    return F.round(v).cast("long")


def _even_or_uneven(x: Column, y: Column, z: Column, resolution: int) -> tuple[Column, Column, list[Column], list[Column]]:
    """Whether a point is in range, whether the even point is as near as the uneven one, and both."""
    scaled = [c * float(2**resolution) for c in (x, y, z)]
    even = [_round(c / 2) * 2 for c in scaled]
    uneven = [_round((c - 1) / 2) * 2 + 1 for c in scaled]
    far = lambda p: sum(((a - b) * (a - b) for a, b in zip(p, scaled, strict=True)), F.lit(0.0))
    good = F.lit(True)
    for c in scaled:
        good = good & ~F.isnan(c) & (F.abs(c) <= float(2**31 - 2))
    return good, far(even) <= far(uneven), even, uneven


def physical_to_lattice(x: Column, y: Column, z: Column, resolution: int = 0) -> tuple[Column, Column, Column]:
    """The nearest lattice point after scaling by 2**resolution; even points win ties. Not finite or out of range: null."""
    good, nearer, even, uneven = _even_or_uneven(x, y, z, resolution)
    return tuple(F.when(good, F.when(nearer, a).otherwise(b)) for a, b in zip(even, uneven, strict=True))


def nearest_point(x: Column, y: Column, z: Column, resolution: int = 0) -> Column:
    """physical_to_lattice() as a point. Within lambdas, where nothing is shared between columns, this compares once, not for each axis."""
    good, nearer, even, uneven = _even_or_uneven(x, y, z, resolution)
    nowhere = point(*[F.lit(None).cast("long")] * 3)
    return F.when(good, F.when(nearer, point(*even)).otherwise(point(*uneven))).otherwise(nowhere)


def physical_to_voxel(x: Column, y: Column, z: Column, size: float) -> tuple[Column, Column, Column]:
    """Rounds to voxels, then moves to the lattice."""
    return snap(*(_round(c / size) for c in (x, y, z)))


#: Fixed value: how far integer points are from what snap() gives, at most, as the mapping layers state it.
MAX_SNAP_ERROR = 0.75**0.5


def parent(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The one point whose children have (x, y, z)."""
    half = [F.shiftright(c, 1) for c in (x, y, z)]
    # An even point is 2 p, or 2 p + 2 on one axis: there the half's parity is alone.
    alone = odd(half[0]) + odd(half[1]) + odd(half[2])
    even = [F.when(((alone == 1) & (odd(h) == 1)) | ((alone == 2) & (odd(h) == 0)), h - 1).otherwise(h) for h in half]
    first = F.shiftright(x - 1, 1)
    uneven = [first, *(F.when(odd(F.shiftright(c - 1, 1)) == odd(first), F.shiftright(c - 1, 1)).otherwise(F.shiftright(c + 1, 1)) for c in (y, z))]
    return tuple(F.when(odd(x) == 0, a).otherwise(b) for a, b in zip(even, uneven, strict=True))


def children(x: Column, y: Column, z: Column) -> Column:
    """An array of eight points."""
    return F.array(*[point(x * 2 + a, y * 2 + b, z * 2 + c) for a, b, c in CHILDREN])


def neighbors(x: Column, y: Column, z: Column) -> Column:
    """An array of the 14 neighbours, in their order."""
    return F.array(*[point(x + a, y + b, z + c) for a, b, c in NEIGHBORS])


def linear_index(x: Column, y: Column, z: Column, extent: tuple[int, int, int]) -> Column:
    """Row-major number of a cell in a box from 0 on; null outside."""
    inside = F.lit(True)
    for c, n in zip((x, y, z), extent, strict=True):
        inside = inside & (c >= 0) & (c < n)
    return F.when(inside, (x * extent[1] + y) * extent[2] + z)


def from_linear_index(i: Column, extent: tuple[int, int, int]) -> tuple[Column, Column, Column]:
    return F.floor(i / (extent[1] * extent[2])).cast("long"), F.floor(i / extent[2]).cast("long") % extent[1], i % extent[2]


class Grid:
    """Cells of a size in physical units: cells at points as Route64 of tier 0, and their centres."""

    def __init__(self, size: float):
        if not (size > 0 and size < float("inf")):
            raise ValueError("a cell's size must be positive and finite")
        self.size = float(size)

    def lattice_at(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        return physical_to_lattice(*[c / (self.size / 2) for c in (x, y, z)])

    def cell_at(self, x: Column, y: Column, z: Column) -> Column:
        from .ids import route64

        return route64(F.lit(0), *self.lattice_at(x, y, z))

    def center_of(self, route: Column) -> tuple[Column, Column, Column]:
        from .ids import route_coords

        return tuple(c * (self.size / 2) for c in route_coords(route))

    def distance(self, a: Column, b: Column) -> Column:
        from .ids import route_coords

        return euclid(*[p - q for p, q in zip(route_coords(a), route_coords(b), strict=True)]) * (self.size / 2)


def _by_size(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    size = [F.abs(d) for d in (dx, dy, dz)]
    most, least = F.greatest(*size), F.least(*size)
    return most, size[0] + size[1] + size[2] - most - least, least


def hops(dx: Column, dy: Column, dz: Column) -> Column:
    """Steps between two lattice points without obstacles."""
    a, b, _ = _by_size(dx, dy, dz)
    return F.shiftright(a + b, 1)


def path_cost(dx: Column, dy: Column, dz: Column) -> Column:
    """Length of the shortest way over edges, in lattice units, without obstacles."""
    a, b, _ = _by_size(dx, dy, dz)
    return b * (3.0**0.5) + (a - b)


def morton_less(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> Column:
    """Whether p's Morton code is below q's, without either: the axis with the highest differing bit decides, z before y before x.
    Coordinates are from 0 on."""
    x, y, z = (a.bitwiseXOR(b) for a, b in zip(p, q, strict=True))
    lower = lambda a, b: (a < b) & (a < a.bitwiseXOR(b))  # noqa: E731  # a's highest bit is below b's
    by_y = lower(z, y)
    by_x = lower(F.when(by_y, y).otherwise(z), x)
    return F.when(by_x, p[0] < q[0]).when(by_y, p[1] < q[1]).otherwise(p[2] < q[2])


def manhattan(dx: Column, dy: Column, dz: Column) -> Column:
    return F.abs(dx) + F.abs(dy) + F.abs(dz)


def chebyshev(dx: Column, dy: Column, dz: Column) -> Column:
    return F.greatest(F.abs(dx), F.abs(dy), F.abs(dz))


def euclid_squared(dx: Column, dy: Column, dz: Column) -> Column:
    return dx * dx + dy * dy + dz * dz


def euclid(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(euclid_squared(dx, dy, dz).cast("double"))


def ring_offsets(k: int) -> list[tuple[int, int, int, int]]:
    """Offsets with their hops, up to k: no search, since hops have a closed form."""
    reach = range(-2 * k, 2 * k + 1)
    out = []
    for x in reach:
        for y in reach:
            for z in reach:
                if (x & 1) == (y & 1) == (z & 1):
                    _, b, a = sorted((abs(x), abs(y), abs(z)))
                    if (a + b) // 2 <= k:
                        out.append((x, y, z, (a + b) // 2))
    return out
