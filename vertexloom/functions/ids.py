"""Packed cell ids as Column functions: space-filling codes, 64-bit and 128-bit keys, flags.

Keys with bit 63 set are negative as BIGINT; all keys of a type share their top bits, so that signed order within a type
is unsigned order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lattice import NEIGHBORS, children, is_valid, neighbors, parent

MORTON_BITS = 48
#: Shifts and masks that spread 16 bits to every third place.
_SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]
_LOW, _LEVELS = 0x249249249249, 0x6DB6DB6DB6DB
INDEX, ROUTE, HILBERT = 2, 1, 3
ROUTE_MIN, ROUTE_MAX = -(1 << 19), (1 << 19) - 1
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
#: Flag bits of a cell.
FLAGS = {"BLOCKED": 1, "NO_FLY": 2, "WATER": 4, "BOUNDARY": 8}


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def _spread(v: Column) -> Column:
    v = v.cast("long")
    for k, mask in _SPREAD:
        v = _and(v.bitwiseOR(F.shiftleft(v, k)), mask)
    return v


def _compact(v: Column) -> Column:
    v = _and(v, _SPREAD[-1][1])
    for (k, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0xFFFF], strict=True):
        v = _and(v.bitwiseXOR(F.shiftright(v, k)), mask)
    return v


def morton(x: Column, y: Column, z: Column) -> Column:
    """Bits of x at 3 i, of y at 3 i + 1, of z at 3 i + 2; coordinates of 16 bits."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def morton_decode(m: Column) -> tuple[Column, Column, Column]:
    return tuple(_compact(F.shiftright(m, k)) for k in range(3))


def gray(m: Column) -> Column:
    """The Gray code of each octant of a Morton code."""
    return m.bitwiseXOR(_and(F.shiftright(m, 1), _LEVELS))


def gray_decode(g: Column) -> Column:
    return g.bitwiseXOR(_and(F.shiftright(g, 1), _LEVELS)).bitwiseXOR(_and(F.shiftright(g, 2), _LOW))


def _head(kind: int, tier: Column, frame: Column, lod: Column) -> Column:
    bits = F.shiftleft(tier.cast("long"), 60).bitwiseOR(F.shiftleft(frame.cast("long"), 52)).bitwiseOR(F.shiftleft(lod.cast("long"), 48))
    top = kind << 62
    return bits.bitwiseOR(F.lit(top - (1 << 64) if top >= 1 << 63 else top).cast("long"))


def _good(tier, frame, lod, *coords) -> Column:
    good = tier.between(0, 3) & frame.between(0, 255) & lod.between(0, 15)
    for c in coords:
        good = good & c.between(0, 65535)
    return good


def index64(frame: Column, tier: Column, lod: Column, x: Column, y: Column, z: Column, strict: bool = False) -> Column:
    """Null where a field is out of range, or an error if strict, as a batch is encoded whole or not at all. Parity isn't asked for."""
    bad = F.raise_error("a field of a key is out of range").cast("long") if strict else F.lit(None).cast("long")
    return F.when(_good(tier, frame, lod, x, y, z), index_of_code(frame, tier, lod, morton(x, y, z))).otherwise(bad)


def index_of_code(frame: Column, tier: Column, lod: Column, m: Column) -> Column:
    """Index64 of a Morton code whose fields are known to be good."""
    return _head(INDEX, tier, frame, lod).bitwiseOR(m)


def hilbert_of_code(frame: Column, tier: Column, lod: Column, m: Column) -> Column:
    return _head(HILBERT, tier, frame, lod).bitwiseOR(gray(m))


def index_valid(k: Column) -> Column:
    """Whether a number is an Index64."""
    return kind(k) == INDEX


def index_to_route(k: Column) -> Column:
    """Route64 of the same tier and coordinates; null where those are of mixed parity."""
    return route64(tier(k), *morton_decode(code(k)))


def _inside(steps: tuple[int, int, int], axes: list[Column], low: list[int], high: list[int]) -> Column:
    """Whether a step stays within [low, high] on each axis that it moves on."""
    good = F.lit(True)
    for d, v, a, b in zip(steps, axes, low, high, strict=True):
        if d:
            good = good & (v <= F.lit(b).cast("long") if d > 0 else v >= F.lit(a).cast("long"))
    return good


def index_neighbors(k: Column) -> Column:
    """Keys of the neighbours within 16 bits, in their order; frame, tier and level stay.

    Steps are taken on the spread bits of each axis, and no lambda is used (here and below), so that all of it is generated code.
    """
    masks = [_LOW << i for i in range(3)]
    spread = lambda v, i: sum((v >> bit & 1) << 3 * bit for bit in range(16)) << i
    axes = [_and(k, m) for m in masks]
    head = _and(k, (1 << 62) - (1 << MORTON_BITS)).bitwiseOR(F.lit(-(1 << 63)).cast("long"))

    def moved(v: Column, d: int, i: int) -> Column:
        by = F.lit(spread(abs(d), i)).cast("long")
        # Ones between an axis's bits carry to its next one.
        return v if not d else _and(v.bitwiseOR(F.lit(~masks[i]).cast("long")) + by if d > 0 else v - by, masks[i])

    near = []
    for steps in NEIGHBORS:
        key = head
        for i, (v, d) in enumerate(zip(axes, steps, strict=True)):
            key = key.bitwiseOR(moved(v, d, i))
        ends = [spread(abs(d), i) for i, d in enumerate(steps)], [spread(65535 - abs(d), i) for i, d in enumerate(steps)]
        near.append(F.when(_inside(steps, axes, *ends), key).otherwise(F.lit(0).cast("long")))  # no key is 0
    return F.array_remove(F.array(*near), F.lit(0).cast("long"))


def route_neighbors(k: Column) -> Column:
    """Keys of the neighbours within 20 bits, in their order; none of a key of mixed parity."""
    k = F.when(is_valid(*route_coords(k)), k)
    axes = route_coords(k)
    near = []
    for steps in NEIGHBORS:
        ends = [ROUTE_MIN + abs(d) for d in steps], [ROUTE_MAX - abs(d) for d in steps]
        key = _and(k, 3 << 60).bitwiseOR(F.lit(ROUTE << 62).cast("long"))
        for v, d, at in zip(axes, steps, (40, 20, 0), strict=True):
            key = key.bitwiseOR(F.shiftleft(_and(v + d, (1 << 20) - 1), at))
        near.append(F.when(_inside(steps, axes, *ends), key).otherwise(F.lit(0).cast("long")))  # no key is 0
    return F.array_remove(F.array(*near), F.lit(0).cast("long"))


def galactic_neighbors(g: Column) -> Column:
    """Keys of the neighbours within 32 bits, in their order, with all attributes; null ones of a key of mixed parity."""
    f = galactic_fields(g)
    axes = [f[c] for c in "xyz"]
    zero = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))  # no key, as the version is 1
    near = []
    for steps in NEIGHBORS:
        ends = [INT_MIN + abs(d) for d in steps], [INT_MAX - abs(d) for d in steps]
        key = galactic128(f["frame"], f["mant"], f["tier"], f["lod"], f["user"], *[v + d for v, d in zip(axes, steps, strict=True)])
        near.append(F.when(_inside(steps, axes, *ends), key).otherwise(zero))
    return F.array_remove(F.array(*near), zero)


def galactic_valid(g: Column) -> Column:
    """Whether 128 bits are a key: the version is 1 and parity holds; all other fields take any value."""
    f = galactic_fields(g)
    return (f["version"] == 1) & is_valid(f["x"], f["y"], f["z"])


def cell_neighbors(c: Column) -> Column:
    """Neighbours of the same frame and resolution; exponent and flags are 0."""
    f = cell_fields(c)
    zero = F.lit(0)
    return F.transform(neighbors(f["x"], f["y"], f["z"]), lambda p: cell_id(f["frame"], f["resolution"], zero, zero, p["x"], p["y"], p["z"]))


_CELL = "struct<hi:bigint,lo:bigint>"


def cell_parent(c: Column, strict: bool = False) -> Column:
    """The lattice parent at one resolution less; exponent and flags are 0. Null at 0, or an error if strict."""
    f = cell_fields(c)
    zero = F.lit(0)
    none = F.raise_error("a cell of resolution 0 has no parent").cast(_CELL) if strict else F.lit(None).cast(_CELL)
    up = cell_id(f["frame"], f["resolution"] - 1, zero, zero, *parent(f["x"], f["y"], f["z"]))
    return F.when(f["resolution"] > 0, up).otherwise(none)


def cell_children(c: Column, strict: bool = False) -> Column:
    """The eight lattice children at one resolution more; exponent and flags are 0. Null at 255, or an error if strict."""
    f = cell_fields(c)
    zero = F.lit(0)
    none = F.raise_error("a cell of resolution 255 has no children").cast(f"array<{_CELL}>") if strict else F.lit(None).cast(f"array<{_CELL}>")
    down = F.transform(children(f["x"], f["y"], f["z"]), lambda p: cell_id(f["frame"], f["resolution"] + 1, zero, zero, p["x"], p["y"], p["z"]))
    return F.when(f["resolution"] < 255, down).otherwise(none)


def display_galactic(g: Column) -> Column:
    f = galactic_fields(g)
    return F.format_string("G128(f=%d, t=%d:%d, lod=%d, %d,%d,%d)", *[f[n] for n in ("frame", "tier", "mant", "lod", "x", "y", "z")])


def display_cell(c: Column) -> Column:
    f = cell_fields(c)
    return F.format_string("CellID(frame=%d, res=%d, x=%d, y=%d, z=%d)", *[f[n] for n in ("frame", "resolution", "x", "y", "z")])


def hilbert64(frame: Column, tier: Column, lod: Column, x: Column, y: Column, z: Column) -> Column:
    return F.when(_good(tier, frame, lod, x, y, z), hilbert_of_code(frame, tier, lod, morton(x, y, z)))


def tier(k: Column) -> Column:
    return _and(F.shiftrightunsigned(k, 60), 3)


def frame(k: Column) -> Column:
    return _and(F.shiftrightunsigned(k, 52), 255)


def lod(k: Column) -> Column:
    return _and(F.shiftrightunsigned(k, 48), 15)


def code(k: Column) -> Column:
    return _and(k, (1 << MORTON_BITS) - 1)


def kind(k: Column) -> Column:
    """2 for Index64, 1 for Route64, 3 for Hilbert64."""
    return F.shiftrightunsigned(k, 62)


def index_to_hilbert(k: Column) -> Column:
    return _head(HILBERT, tier(k), frame(k), lod(k)).bitwiseOR(gray(code(k)))


def hilbert_to_index(k: Column) -> Column:
    return _head(INDEX, tier(k), frame(k), lod(k)).bitwiseOR(gray_decode(code(k)))


def index_parent(k: Column) -> Column:
    """One level up by the Morton code; null at level 0."""
    return F.when(lod(k) > 0, _head(INDEX, tier(k), frame(k), lod(k) - 1).bitwiseOR(F.shiftrightunsigned(code(k), 3)))


def index_children(k: Column) -> Column:
    """Eight keys one level down, of the lowest 48 bits; none at level 15."""
    below = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), lambda i: _head(INDEX, tier(k), frame(k), lod(k) + 1).bitwiseOR(_and(F.shiftleft(code(k), 3).bitwiseOR(i), (1 << MORTON_BITS) - 1)))
    return F.when(lod(k) < 15, below).otherwise(F.array().cast("array<bigint>"))


def hilbert_parent(k: Column) -> Column:
    return F.when(lod(k) > 0, _head(HILBERT, tier(k), frame(k), lod(k) - 1).bitwiseOR(F.shiftrightunsigned(code(k), 3)))


def hilbert_children(k: Column) -> Column:
    """As index_children(), but at level 15 the key itself, eight times."""
    step = lambda i: _head(HILBERT, tier(k), frame(k), lod(k) + 1).bitwiseOR(_and(F.shiftleft(code(k), 3).bitwiseOR(i), (1 << MORTON_BITS) - 1))
    return F.when(lod(k) < 15, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), step)).otherwise(F.array_repeat(k, 8))


def route64(tier_: Column, x: Column, y: Column, z: Column, checked: bool = True) -> Column:
    """Signed coordinates of 20 bits; null where out of range or, if checked, of mixed parity."""
    packed = F.shiftleft(tier_.cast("long"), 60)
    for c, at in ((x, 40), (y, 20), (z, 0)):
        packed = packed.bitwiseOR(F.shiftleft(_and(c.cast("long"), (1 << 20) - 1), at))
    good = tier_.between(0, 3)
    for c in (x, y, z):
        good = good & c.between(ROUTE_MIN, ROUTE_MAX)
    return F.when(good & is_valid(x, y, z) if checked else good, packed.bitwiseOR(F.lit(ROUTE << 62).cast("long")))


def route_coords(k: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(F.shiftleft(k, 4 + at), 44) for at in (0, 20, 40))


def route_valid(k: Column) -> Column:
    return (kind(k) == ROUTE) & is_valid(*route_coords(k))


def galactic128(frame_, mant, tier_, level, user, x, y, z) -> Column:
    """struct(hi, lo): mantissa 8, tier 2, level 6, frame 8, version 4 (1), user 4, x 32 | y 32, z 32; checked."""
    hi = F.shiftleft(mant.cast("long"), 56).bitwiseOR(F.shiftleft(tier_.cast("long"), 54)).bitwiseOR(F.shiftleft(level.cast("long"), 48))
    hi = hi.bitwiseOR(F.shiftleft(frame_.cast("long"), 40)).bitwiseOR(F.lit(1 << 36).cast("long")).bitwiseOR(F.shiftleft(user.cast("long"), 32)).bitwiseOR(_and(x.cast("long"), 0xFFFFFFFF))
    lo = F.shiftleft(_and(y.cast("long"), 0xFFFFFFFF), 32).bitwiseOR(_and(z.cast("long"), 0xFFFFFFFF))
    good = tier_.between(0, 3) & level.between(0, 63) & user.between(0, 15) & frame_.between(0, 255) & mant.between(0, 255) & is_valid(x, y, z)
    return F.when(good, F.struct(hi.alias("hi"), lo.alias("lo")))


def galactic_fields(g: Column) -> dict[str, Column]:
    hi, lo = g["hi"], g["lo"]
    field = lambda at, bits: _and(F.shiftrightunsigned(hi, at), (1 << bits) - 1)
    signed = lambda v: F.shiftright(F.shiftleft(v, 32), 32)
    return {
        "mant": field(56, 8), "tier": field(54, 2), "lod": field(48, 6), "frame": field(40, 8), "version": field(36, 4), "user": field(32, 4),
        "x": signed(hi), "y": F.shiftright(lo, 32), "z": signed(lo),
    }


def cell_id(frame_, resolution, exponent, flags, x, y, z) -> Column:
    """The older 128-bit key as struct(hi, lo): z, y | x, reserved, flags, exponent, resolution, frame."""
    lo = frame_.cast("long").bitwiseOR(F.shiftleft(resolution.cast("long"), 8)).bitwiseOR(F.shiftleft(exponent.cast("long"), 16)).bitwiseOR(F.shiftleft(flags.cast("long"), 20))
    lo = lo.bitwiseOR(F.shiftleft(_and(x.cast("long"), 0xFFFFFFFF), 32))
    hi = _and(y.cast("long"), 0xFFFFFFFF).bitwiseOR(F.shiftleft(_and(z.cast("long"), 0xFFFFFFFF), 32))
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def cell_fields(c: Column) -> dict[str, Column]:
    signed = lambda v: F.shiftright(F.shiftleft(v, 32), 32)
    part = lambda at, bits: _and(F.shiftrightunsigned(c["lo"], at), (1 << bits) - 1)
    return {"frame": part(0, 8), "resolution": part(8, 8), "exponent": part(16, 4), "flags": part(20, 8), "x": F.shiftright(c["lo"], 32), "y": signed(c["hi"]), "z": F.shiftright(c["hi"], 32)}


def unsigned_order(v: Column) -> Column:
    """Sorts as the unsigned value would."""
    return v.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def key_bytes(hi: Column, lo: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def display_index(k: Column) -> Column:
    return F.format_string("I64(f=%d,t=%d,l=%d,m=%012x)", frame(k), tier(k), lod(k), code(k))


def display_route(k: Column) -> Column:
    return F.format_string("R64(t=%d,x=%d,y=%d,z=%d)", tier(k), *route_coords(k))


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def set_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseOR(FLAGS[name])


def clear_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(~FLAGS[name])
