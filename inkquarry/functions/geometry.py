"""Geometry of pages and measurements as Column expressions over ``array<struct<x,y>>``, rectangles and matrices.

Pages count from 1 and coordinates are those of the view: origin at the top left, y downwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(points: Column) -> Column:
    n = F.size(points)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(points[i].alias("a"), points[i + 1].alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def length(points: Column, scale: Column | float = 1.0) -> Column:
    """Sum of the segments; 0 for fewer than two points."""
    s = scale if isinstance(scale, Column) else F.lit(scale)
    return F.aggregate(_pairs(points), F.lit(0.0), lambda acc, p: acc + distance(p["a"], p["b"])) * s


def perimeter(points: Column, scale: Column | float = 1.0) -> Column:
    return length(F.concat(points, F.slice(points, 1, 1)), scale)


def area(points: Column, sx: Column | float = 1.0, sy: Column | float = 1.0) -> Column:
    """Area within the points by the shoelace formula, with a scale for either axis; 0 for fewer than three."""
    closed = F.concat(points, F.slice(points, 1, 1))
    twice = F.aggregate(_pairs(closed), F.lit(0.0), lambda acc, p: acc + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]))
    return F.when(F.size(points) > 2, F.abs(twice) / 2 * sx * sy).otherwise(0.0)


def angle(a: Column, corner: Column, b: Column) -> Column:
    """Angle at a corner in degrees, 0 to 180; null where two points coincide."""
    dot = (a["x"] - corner["x"]) * (b["x"] - corner["x"]) + (a["y"] - corner["y"]) * (b["y"] - corner["y"])
    product = distance(a, corner) * distance(b, corner)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, product)))))


def overlaps(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Whether two rectangles [x0, y0, x1, y1] share more than their edges."""
    return (a[0] < b[2] - eps) & (b[0] < a[2] - eps) & (a[1] < b[3] - eps) & (b[1] < a[3] - eps)


def contains(outer: Column, inner: Column, eps: float = 0.0) -> Column:
    return (outer[0] <= inner[0] + eps) & (outer[1] <= inner[1] + eps) & (outer[2] >= inner[2] - eps) & (outer[3] >= inner[3] - eps)


def displayed_size(width: Column, height: Column, crop: Column, rotation: Column) -> Column:
    """struct(width, height) as shown: the crop box if there is one, turned with the page."""
    w = F.coalesce(F.abs(F.get(crop, F.lit(2)) - F.get(crop, F.lit(0))), width)
    h = F.coalesce(F.abs(F.get(crop, F.lit(3)) - F.get(crop, F.lit(1))), height)
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def to_view(x: Column, y: Column, crop: Column, rotation: Column) -> Column:
    """struct(x, y) of a user-space point in view space."""
    x0, y0, x1, y1 = (crop[i] for i in range(4))
    r = F.pmod(rotation, F.lit(360))
    vx = F.when(r == 90, y - y0).when(r == 180, x1 - x).when(r == 270, y1 - y).otherwise(x - x0)
    vy = F.when(r == 90, x - x0).when(r == 180, y - y0).when(r == 270, x1 - x).otherwise(y1 - y)
    return F.struct(vx.alias("x"), vy.alias("y"))


def to_user(x: Column, y: Column, crop: Column, rotation: Column) -> Column:
    """The inverse of ``to_view``."""
    x0, y0, x1, y1 = (crop[i] for i in range(4))
    r = F.pmod(rotation, F.lit(360))
    ux = F.when(r == 90, y + x0).when(r == 180, x1 - x).when(r == 270, x1 - y).otherwise(x + x0)
    uy = F.when(r == 90, x + y0).when(r == 180, y + y0).when(r == 270, y1 - x).otherwise(y1 - y)
    return F.struct(ux.alias("x"), uy.alias("y"))


def compose(m: Column, n: Column) -> Column:
    """Matrix [a b c d e f] of applying m first, then n."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    g, h, i, j, k, o = (n[i] for i in range(6))
    return F.array(a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def invert(m: Column) -> Column:
    """Inverse matrix; null if there is none."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    det = a * d - b * c
    return F.when(F.abs(det) > 1e-12, F.transform(F.array(d, -b, -c, a, c * f - d * e, b * e - a * f), lambda v: v / det))


def intersection(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Point where segments pq and rs cross; null where they don't or are parallel."""
    dx, dy, ex, ey = q["x"] - p["x"], q["y"] - p["y"], s["x"] - r["x"], s["y"] - r["y"]
    det = dx * ey - dy * ex
    t = F.try_divide((r["x"] - p["x"]) * ey - (r["y"] - p["y"]) * ex, det)
    u = F.try_divide((r["x"] - p["x"]) * dy - (r["y"] - p["y"]) * dx, det)
    return F.when((F.abs(det) > 1e-12) & t.between(0, 1) & u.between(0, 1), F.struct((p["x"] + t * dx).alias("x"), (p["y"] + t * dy).alias("y")))
