"""Scalar geometry of regions: axes, orientation, angles, boxes and point sets, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ellipse_axes(sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column]:
    """Major and minor axis from second moments."""
    half, root = (sxx + syy) / 2, F.sqrt(4 * sxy * sxy + (sxx - syy) * (sxx - syy)) / 2
    return F.sqrt(half + root), F.sqrt(F.greatest(F.lit(0.0), half - root))


def same_area_axes(area: Column, major: Column, minor: Column) -> tuple[Column, Column]:
    """Axes of the same ratio whose ellipse has the given area."""
    ratio = major / minor
    short = F.sqrt(area / (ratio * F.pi()))
    return short * ratio, short


def orientation(sxx: Column, syy: Column, sxy: Column) -> Column:
    """Angle of the major axis, from 0 to below pi."""
    theta = -0.5 * F.atan2(2 * sxy, sxx - syy)
    return F.when(theta < 0, theta + F.pi()).otherwise(theta)


def eccentricity(major: Column, minor: Column) -> Column:
    return 1 - F.sqrt(minor / major)


def ellipse_area_ratio(major: Column, minor: Column, area: Column) -> Column:
    return 4 * major * minor / area


def axis_end(x: Column, y: Column, major: Column, theta: Column, side: int) -> Column:
    """An end of the major axis, one pixel further out: side 1 or -1."""
    dy, dx = major * F.sin(-theta), major * F.cos(-theta)
    return F.struct((F.ceil(x + side * dx) + side).cast("int").alias("x"), (F.ceil(y + side * dy) + side).cast("int").alias("y"))


def movement_angle(dx: Column, dy: Column, major: Column, theta: Column) -> Column:
    """Angle between a movement and the major axis, folded to 0..pi/2; 0 if either is shorter than 2."""
    length = F.sqrt(dx * dx + dy * dy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dx * F.cos(-theta) + dy * F.sin(-theta)) / length))
    phi = F.acos(cosine)
    return F.when((length < 2) | (major < 2), F.lit(0.0)).otherwise(F.least(phi, F.pi() - phi))


def axis_projection(dx: Column, dy: Column, theta: Column) -> Column:
    """Length of a movement along the major axis, whichever end is the head."""
    return F.abs(dx * F.cos(-theta) + dy * F.sin(-theta))


def axis_angle_error(a: Column, b: Column) -> Column:
    """Difference of two directions in degrees when head and tail are alike: 0..90."""
    v = F.pmod(F.abs(a - b), F.lit(180))
    return F.least(v, 180 - v)


def angle_error(a: Column, b: Column) -> Column:
    """Difference of two directions in degrees: 0..180."""
    v = F.pmod(a - b, F.lit(360))
    return F.least(v, 360 - v)


def box_holds(x: Column, y: Column, bx: Column, by: Column, w: Column, h: Column, tolerance: int = 0) -> Column:
    """The point lies in the box, edges included."""
    return x.between(bx - tolerance, bx + w - 1 + tolerance) & y.between(by - tolerance, by + h - 1 + tolerance)


def boxes_touch(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column, margin: float = 0) -> Column:
    """The boxes intersect or touch, the first widened by ``margin``."""
    return (ax - margin <= bx + bw) & (ax + aw + margin >= bx) & (ay - margin <= by + bh) & (ay + ah + margin >= by)


def box_union(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    x, y = F.least(ax, bx), F.least(ay, by)
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(ax + aw, bx + bw) - x).alias("w"), (F.greatest(ay + ah, by + bh) - y).alias("h"))


def clamp(v: Column, low: Column, size: Column) -> Column:
    """Nearest coordinate inside a box side; its end is exclusive."""
    return F.least(F.greatest(v, low), low + size - 1)


def runs_to_points(runs: Column) -> Column:
    """Points of run-length rows (line, col1, col2 inclusive)."""
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(r["col1"], r["col2"]), lambda c: F.struct(r["line"].alias("y"), c.alias("x")))))


def in_ellipse(px: Column, py: Column, x: Column, y: Column, major: Column, minor: Column, theta: Column) -> Column:
    """Whether a pixel lies inside an ellipse, its edge included."""
    dx, dy, c, s = px - x, py - y, F.cos(theta), F.sin(theta)
    return (dx * c - dy * s) ** 2 / major**2 + (dx * s + dy * c) ** 2 / minor**2 <= 1 + 1e-9


def turned_by(a: Column, b: Column) -> Column:
    """Degrees between two directions, up to 180."""
    return F.least(F.abs(a - b) % 360, 360 - F.abs(a - b) % 360)


def rotate(points: Column, angle: Column, cx: Column, cy: Column) -> Column:
    """Points turned around a centre, rounded to whole pixels."""
    s, c = F.sin(angle), F.cos(angle)
    return F.transform(points, lambda p: F.struct(
        F.round(cy + (p["y"] - cy) * c - (p["x"] - cx) * s).cast("int").alias("y"), F.round(cx + (p["y"] - cy) * s + (p["x"] - cx) * c).cast("int").alias("x"),
    ))


def point_set_loss(a: Column, b: Column) -> Column:
    """Points that only one of the sets has."""
    both = F.size(F.array_intersect(a, b))
    return F.size(a) + F.size(b) - 2 * both


CLASS_NAMES = {-1: "undefined", 0: "single", 1: "multi", 2: "noise", 3: "part"}


def class_name(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in CLASS_NAMES.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out
