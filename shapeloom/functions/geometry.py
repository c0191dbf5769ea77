"""Plane geometry as Column functions; they stay inside whole-stage code generation.

A similarity is a struct (a00, a01, a10, a11, b0, b1) that maps p to A p + b.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITY = "struct<a00:double,a01:double,a10:double,a11:double,b0:double,b1:double>"
EPS = 1e-12
EARTH_RADIUS_M = 6_371_000.0


def similarity(a00, a01, a10, a11, b0, b1) -> Column:
    parts = {"a00": a00, "a01": a01, "a10": a10, "a11": a11, "b0": b0, "b1": b1}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in parts.items()])


def identity() -> Column:
    return similarity(1, 0, 0, 1, 0, 0)


def from_components(scale: Column, angle: Column, tx: Column, ty: Column, reflect: bool = False) -> Column:
    """Scale times rotation, after a flip of y if reflect is set, then a shift."""
    c, s, flip = scale * F.cos(angle), scale * F.sin(angle), -1.0 if reflect else 1.0
    return similarity(c, -s * flip, s, c * flip, tx, ty)


def determinant(t: Column) -> Column:
    return t["a00"] * t["a11"] - t["a01"] * t["a10"]


def scale_of(t: Column) -> Column:
    return F.sqrt(F.abs(determinant(t)))


def rotation_of(t: Column) -> Column:
    return F.atan2(t["a10"], t["a00"])


def keeps_orientation(t: Column) -> Column:
    return determinant(t) > 0


def apply_x(t: Column, x: Column, y: Column) -> Column:
    return t["a00"] * x + t["a01"] * y + t["b0"]


def apply_y(t: Column, x: Column, y: Column) -> Column:
    return t["a10"] * x + t["a11"] * y + t["b1"]


def compose(outer: Column, inner: Column) -> Column:
    """p -> outer(inner(p))."""
    o, i = outer, inner
    return similarity(
        o["a00"] * i["a00"] + o["a01"] * i["a10"],
        o["a00"] * i["a01"] + o["a01"] * i["a11"],
        o["a10"] * i["a00"] + o["a11"] * i["a10"],
        o["a10"] * i["a01"] + o["a11"] * i["a11"],
        apply_x(o, i["b0"], i["b1"]),
        apply_y(o, i["b0"], i["b1"]),
    )


def inverse(t: Column) -> Column:
    d = determinant(t)
    a00, a01, a10, a11 = t["a11"] / d, -t["a01"] / d, -t["a10"] / d, t["a00"] / d
    return similarity(a00, a01, a10, a11, -(a00 * t["b0"] + a01 * t["b1"]), -(a10 * t["b0"] + a11 * t["b1"]))


def frame_of_edge(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The proper similarity with (ax, ay) -> (0, 0) and (bx, by) -> (1, 0); null for a zero-length edge. Free of trigonometry."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    c, s = dx / n, dy / n
    return F.when(F.hypot(dx, dy) >= EPS, similarity(c, s, -s, c, -(c * ax + s * ay), -(c * ay - s * ax)))


def cross(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Twice the signed area of the triangle o, a, b."""
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def polar_cell(x: Column, y: Column, n_angle: int = 10, n_dist: int = 12, max_radius: float = 3.0) -> Column:
    """struct(ai, di) of a point, null at the origin and beyond the radius. An angle just below 0 falls into the last bin."""
    r, turn = F.hypot(x, y), 2.0 * F.pi()
    theta = F.atan2(y, x)
    theta = F.when(theta < 0, theta + turn).otherwise(theta)
    ai = F.least(F.floor(theta / turn * n_angle), F.lit(n_angle - 1)).cast("int")
    di = F.least(F.floor(r / max_radius * n_dist), F.lit(n_dist - 1)).cast("int")
    return F.when((r >= EPS) & (r <= max_radius), F.struct(ai.alias("ai"), di.alias("di")))


def cell_center(ai: Column, di: Column, n_angle: int = 10, n_dist: int = 12, max_radius: float = 3.0) -> Column:
    theta, r = (ai + 0.5) / n_angle * 2.0 * F.pi(), (di + 0.5) / n_dist * max_radius
    return F.struct((r * F.cos(theta)).alias("x"), (r * F.sin(theta)).alias("y"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) structs; 0 for fewer than three."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - p["y"] * q["x"])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2)


def project_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    """Metres east of a centre, equirectangular."""
    return EARTH_RADIUS_M * F.radians(lon - lon0) * F.cos(F.radians(lat0))


def project_y(lat: Column, lat0: Column) -> Column:
    return EARTH_RADIUS_M * F.radians(lat - lat0)
