"""Camera and box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where they have no area in common."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def direction(dx: Column, dy: Column) -> Column:
    """Quadrant of a bearing: in_front [-45, 45), left [45, 135), behind, right."""
    a = F.degrees(F.atan2(dy, dx))
    return F.when((a >= -45) & (a < 45), "in_front").when((a >= 45) & (a < 135), "left").when((a >= 135) | (a < -135), "behind").otherwise("right")


def proximity(distance: Column) -> Column:
    return F.when(distance <= 5, "near").when(distance <= 15, "moderate").otherwise("far")


def ground_point(kinv: list[Column], r: list[Column], t: list[Column], u: Column, v: Column) -> Column:
    """Struct x, y where the ray of a pixel meets the ground z = 0; null if it is level or points away.

    kinv, r: nine entries by rows; t: three.  The centre is -R't and the ray R'K^-1 (u, v, 1)."""
    c = [kinv[3 * i] * u + kinv[3 * i + 1] * v + kinv[3 * i + 2] for i in range(3)]
    ray = [r[i] * c[0] + r[3 + i] * c[1] + r[6 + i] * c[2] for i in range(3)]
    centre = [-(r[i] * t[0] + r[3 + i] * t[1] + r[6 + i] * t[2]) for i in range(3)]
    s = F.when(F.abs(ray[2]) > 1e-6, -centre[2] / F.nullif(ray[2], F.lit(0.0)))
    return F.when(s > 0, F.struct((centre[0] + s * ray[0]).alias("x"), (centre[1] + s * ray[1]).alias("y")))


def yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Heading of a quaternion about the upright axis, in radians."""
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def hsv_name(r: Column, g: Column, b: Column) -> Column:
    """A coarse colour name of integer channels 0 to 255: dark and pale first, then the hue's sixth."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    grey = F.when(high < 50, "black").when((high - low) * 100 < 15 * high, F.when(high > 200, "white").otherwise("gray"))
    hue = F.when((r >= g) & (r >= b), F.when(g >= b, "orange").otherwise("pink")).when(g >= b, F.when(r >= b, "yellow").otherwise("green")).otherwise(F.when(g >= r, "blue").otherwise("purple"))
    return F.coalesce(grey, hue)
