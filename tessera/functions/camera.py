"""Cameras: centres, view directions and the ground points of pixels, with matrices as columns or as numbers."""

from __future__ import annotations

import math

#: Cameras with their site, set of shared views and whether they are indoors.
CAMERAS = {
    "school": {"G299": "3-330", "G300": "3-300", "G328": "3-328", "G330": "3-330", "G336": "3-336", "G339": "skip", "G419": "3-420", "G420": "3-420", "G421": "3-421", "G423": "3-423", "G424": "3-424", "G474": "IR-school", "G638": "3-638", "G639": "3-639"},
    "bus": {"G331": "3-331", "G340": "3-340", "G475": "IR-bus", "G505": "3-505", "G506": "3-506", "G508": "3-508", "G509": "3-508"},
    "hospital": {"G301": "3-301", "G341": "3-341", "G436": "3-436", "G476": "3-476", "G479": "3-479"},
    "admin": {"G326": "admin", "G329": "admin"},
}
INDOOR = "G299 G326 G329 G330 G331 G419 G420 G421 G423 G508".split()
# Outdoor cameras that indoor ones lead to.
ADJACENT = {
    "G299": "G300 G328 G336 G424 G638 G639", "G330": "G300 G328 G336 G424 G638 G639", "G419": "G300 G328 G424 G299 G330", "G420": "G300 G328 G424 G299 G330", "G421": "G300 G328 G424",
    "G423": "G300 G328 G424", "G326": "G329", "G329": "G326", "G331": "G340 G505 G506 G509 G508", "G508": "G340 G505 G506 G509 G331",
}
#: Cameras without a common frame of coordinates.
LOCAL = ("G299", "G330")


def camera_rows() -> list[tuple]:
    """camera, site, set, indoor, position (metres) and view direction of each camera; positions and directions are invented by rule,
    as no calibration comes with the data."""
    out = []
    for site, cams in CAMERAS.items():
        for cam, group in cams.items():
            n = int(cam[1:])
            a = math.radians((n * 37) % 360 + 0.25)
            known = cam not in LOCAL
            out.append((cam, site, group, cam in INDOOR, (n * 13) % 120 if known else None, (n * 29) % 90 if known else None, math.cos(a) if known else None, math.sin(a) if known else None))
    return out


CAMERA_DDL = "camera string, site string, cset string, indoor boolean, e long, n long, de double, dn double"


def camera_matrix(yaw: float, pitch: float, height: float, f: float = 1000.0, cx: float = 960.0, cy: float = 540.0) -> tuple[list[float], list[float]]:
    """R'K^-1 by rows and the centre of a camera at a height that looks along a yaw, down by a pitch (degrees)."""
    y, p = math.radians(yaw), math.radians(pitch)
    forward = [math.cos(p) * math.cos(y), math.cos(p) * math.sin(y), -math.sin(p)]
    right = [math.sin(y), -math.cos(y), 0.0]
    down = [-math.sin(p) * math.cos(y), -math.sin(p) * math.sin(y), -math.cos(p)]
    m = []
    for i in range(3):
        m += [right[i] / f, down[i] / f, forward[i] - right[i] * cx / f - down[i] * cy / f]
    return m, [0.0, 0.0, height]


def ground_sql(u: str, v: str, m: list[str], c: list[str]) -> tuple[str, str, str]:
    """Expressions of whether a pixel's ray meets the ground in front of the camera, and of where (east, north).

    m: R'K^-1 by rows; c: the centre.  Lens distortion is not corrected."""
    ray = [f"({m[3 * i]} * ({u}) + {m[3 * i + 1]} * ({v}) + {m[3 * i + 2]})" for i in range(3)]
    t = f"((0.0 - {c[2]}) / nullif({ray[2]}, CAST(0 AS DOUBLE)))"
    return f"abs({ray[2]}) >= 1e-10 AND {t} >= 0", f"({c[0]} + {t} * {ray[0]})", f"({c[1]} + {t} * {ray[1]})"


def tier_sql(dist: str) -> str:
    """same_area, adjacent, same_site or different_site of cameras a and b; dist: their distance or null."""
    adjacent = " OR ".join(f"({x}.camera = '{k}' AND {y}.camera IN ({', '.join(repr(c) for c in v.split())}))" for x, y in ("ab", "ba") for k, v in ADJACENT.items())
    return (
        f"CASE WHEN a.camera = b.camera THEN 'same_area' WHEN a.site <> b.site THEN 'different_site' WHEN a.cset = b.cset THEN 'same_area' WHEN {adjacent} THEN 'adjacent'"
        f" WHEN {dist} < 15 THEN 'same_area' WHEN {dist} < 80 THEN 'adjacent' WHEN {dist} IS NOT NULL THEN 'same_site' WHEN a.indoor <> b.indoor THEN 'adjacent' ELSE 'same_site' END"
    )


#: How good a pair of cameras is for a question, in tenths.
TIER_SCORES = {"adjacent": 30, "same_site": 20, "same_area": 5, "different_site": 0}


def overlap_sql(dist: str, cosine: str) -> str:
    return f"({dist} < 15 OR ({dist} < 30 AND {cosine} > 0.5) OR ({dist} < 50 AND {cosine} > 0.3))"
