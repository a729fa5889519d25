"""Plane geometry as column expressions: space-filling curve, hexagons, segments, radii."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT3 = math.sqrt(3.0)


def quantise(v: Column, low: Column, high: Column, bits: int = 16) -> Column:
    """A coordinate on a grid of 2^bits cells over [low, high], clamped."""
    top = (1 << bits) - 1
    span = F.when(high > low, high - low).otherwise(1.0)
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((v - low) / span * top))).cast("int")


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Position of grid cell (x, y) along the Hilbert curve."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, i: Column) -> Column:
        s = F.expr(f"shiftleft(1L, {bits - 1})")
        s = F.call_function("shiftright", s, i)
        rx = (acc["x"].bitwiseAND(s) > 0).cast("long")
        ry = (acc["y"].bitwiseAND(s) > 0).cast("long")
        d = acc["d"] + s * s * ((F.lit(3).cast("long") * rx).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        top = F.lit((1 << bits) - 1).cast("long")
        fx, fy = F.when(flip, top - acc["x"]).otherwise(acc["x"]), F.when(flip, top - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step, lambda acc: acc["d"])


def hex_to_world(q: Column, r: Column, size: float = 1.0) -> tuple[Column, Column]:
    """Centre of the axial cell (q, r) of a pointy lattice."""
    return F.lit(size * SQRT3) * (q + r / 2), F.lit(size * 1.5) * r


def hex_from_world(x: Column, y: Column, size: float = 1.0) -> Column:
    """struct(q, r): the axial cell that holds a point, by cube rounding."""
    fr = y / F.lit(size * 1.5)
    fq = x / F.lit(size * SQRT3) - fr / 2
    fs = -fq - fr
    q, r, s = F.rint(fq), F.rint(fr), F.rint(fs)
    dq, dr, ds = F.abs(q - fq), F.abs(r - fr), F.abs(s - fs)
    qq = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    rr = F.when((dq > dr) & (dq > ds), r).when(dr > ds, -q - s).otherwise(r)
    return F.struct(qq.cast("int").alias("q"), rr.cast("int").alias("r"))


def hex_distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    dq, dr = q1 - q2, r1 - r2
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")


def hex_ring(i: Column) -> Column:
    """Ring of the i-th cell of a spiral from the centre (ring k has 6k cells)."""
    return F.ceil((F.sqrt(F.lit(12) * i + 9) - 3) / 6).cast("int")


def hex_spiral(i: Column) -> Column:
    """struct(q, r): the i-th cell of the spiral, ring by ring, six sides to a ring."""
    k = hex_ring(i)
    j = i - (F.lit(3) * k * (k - 1) + 1)
    side, at = F.floor(j / F.greatest(k, F.lit(1))).cast("int"), F.pmod(j, F.greatest(k, F.lit(1))).cast("int")
    steps = [(k - at, at), (-at, k), (-k, k - at), (at - k, -at), (at, -k), (k, at - k)]
    q, r = F.lit(0), F.lit(0)
    for n, (dq, dr) in enumerate(steps):
        q, r = F.when((k > 0) & (side == n), dq).otherwise(q), F.when((k > 0) & (side == n), dr).otherwise(r)
    return F.struct(q.cast("int").alias("q"), r.cast("int").alias("r"))


def orient(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Do two segments (x1, y1, x2, y2) strictly straddle each other?"""
    d1, d2 = orient(*a, b[0], b[1]), orient(*a, b[2], b[3])
    d3, d4 = orient(*b, a[0], a[1]), orient(*b, a[2], a[3])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> Column:
    """struct(t0, t1): the part of a segment inside a box as parameters 0 to 1; NULL if outside."""
    dx, dy = x2 - x1, y2 - y1
    low, high, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, q in ((-dx, x1 - box[0]), (dx, F.lit(box[2]) - x1), (-dy, y1 - box[1]), (dy, F.lit(box[3]) - y1)):
        out = out | ((p == 0) & (q < 0))
        low.append(F.when(p < 0, q / F.when(p != 0, p)).otherwise(0.0))
        high.append(F.when(p > 0, q / F.when(p != 0, p)).otherwise(1.0))
    t0, t1 = F.greatest(*low), F.least(*high)
    return F.when(~out & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def mark_radius(degree: Column, phantom: Column, least: float = 4.0, most: float = 40.0) -> Column:
    r = F.least(F.lit(most), F.lit(least) + F.lit(2.5) * F.sqrt(degree + 1.0))
    return F.when(phantom, r * 0.7).otherwise(r)


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return t * t * (F.lit(3.0) - 2 * t)


def link_budget(marks: Column) -> Column:
    """Links drawn around so many marks."""
    return F.greatest(F.lit(200), F.floor(marks * 5 / 2)).cast("int")
