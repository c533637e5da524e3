"""Plane geometry in built-in functions.

A ring is array<struct<x,y>>, closed or not. A polygon is an array of rings under the even-odd
rule, so holes and several parts need no marks: what an odd number of rings encloses is inside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring(*points: tuple[Column | float, Column | float]) -> Column:
    pair = lambda p: F.struct(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double").alias(n) for c, n in zip(p, "xy", strict=True)])
    return F.array(*map(pair, points))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def edges(points: Column) -> Column:
    """array<struct<a, b>> of a ring's sides, none for an empty ring; a closing point makes a side of no length."""
    shifted = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.zip_with(points, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def sides(rings: Column) -> Column:
    """Sides of all rings of a polygon."""
    return F.flatten(F.transform(rings, edges))


def length(points: Column) -> Column:
    """Length of an open line."""
    after = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    parts = F.zip_with(F.slice(points, F.lit(1), F.size(after)), after, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def signed_area(points: Column) -> Column:
    """Area of a simple ring, negative if it runs clockwise."""
    return F.aggregate(edges(points), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(points: Column) -> Column:
    """Area of a simple ring."""
    return F.abs(signed_area(points))


def oriented(rings: Column) -> Column:
    """The rings of a polygon, those with their inside within an even number of others anticlockwise and the others (holes) clockwise, so that signed areas add up to the polygon's. Rings must not cross."""

    def turned(points: Column, k: Column) -> Column:
        others = F.filter(rings, lambda r, i: (i != k) & _crossings_odd((points[0]["x"] + points[1]["x"]) / 2, (points[0]["y"] + points[1]["y"]) / 2, edges(r)))
        outer = F.size(others) % 2 == 0
        return F.when((signed_area(points) >= 0) == outer, points).otherwise(F.reverse(points))

    return F.transform(rings, turned)


def polygon_area(rings: Column) -> Column:
    """Area of a polygon whose rings are :func:`oriented`."""
    return F.aggregate(rings, F.lit(0.0), lambda s, r: s + signed_area(r))


def _on(x: Column, y: Column, of: Column) -> Column:
    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))

    return F.exists(of, on)


def on_border(x: Column, y: Column, points: Column) -> Column:
    return _on(x, y, edges(points))


def _crossings_odd(x: Column, y: Column, of: Column) -> Column:
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(of, crosses)) % 2 == 1


def contains(points: Column, x: Column, y: Column) -> Column:
    """Strictly inside a ring."""
    return contains_sides(edges(points), x, y)


def covers(points: Column, x: Column, y: Column) -> Column:
    """Inside a ring or on its border."""
    return covers_sides(edges(points), x, y)


def contains_sides(of: Column, x: Column, y: Column) -> Column:
    """Strictly inside the polygon of some sides."""
    return _crossings_odd(x, y, of) & ~_on(x, y, of)


def covers_sides(of: Column, x: Column, y: Column) -> Column:
    """Inside the polygon of some sides or on its border."""
    return _crossings_odd(x, y, of) | _on(x, y, of)


def distance_to_sides(of: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the nearest of some sides; null without sides."""

    def far(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / long))).otherwise(0.0)
        return F.hypot(a["x"] + t * dx - x, a["y"] + t * dy - y)

    return F.array_min(F.transform(of, far))


def crossing(e: Column, g: Column) -> tuple[Column, Column, Column, Column]:
    """(x, y, t, u): where the lines of two sides cross, and how far along each side that is (0 to 1 on it); null if they are parallel."""
    a, b, c, d = e["a"], e["b"], g["a"], g["b"]
    det = (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])
    safe = F.when(det != 0, det)
    t = ((c["x"] - a["x"]) * (d["y"] - c["y"]) - (c["y"] - a["y"]) * (d["x"] - c["x"])) / safe
    u = ((c["x"] - a["x"]) * (b["y"] - a["y"]) - (c["y"] - a["y"]) * (b["x"] - a["x"])) / safe
    return a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]), t, u


def share_inside(x0: Column, y0: Column, x1: Column, y1: Column, of: Column) -> Column:
    """Share of a segment that lies inside the polygon of some sides: cut where it meets the sides, each piece judged by its middle. 0 for a segment of no length."""
    dx, dy = x1 - x0, y1 - y0

    def meets(e: Column) -> Column:
        a, b = e["a"], e["b"]
        ex, ey = b["x"] - a["x"], b["y"] - a["y"]
        det = dx * ey - dy * ex
        safe = F.when(det == 0, F.lit(1.0)).otherwise(det)
        t = ((a["x"] - x0) * ey - (a["y"] - y0) * ex) / safe
        u = ((a["x"] - x0) * dy - (a["y"] - y0) * dx) / safe
        return F.when((det != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    cuts = F.filter(F.transform(of, meets), lambda t: t.isNotNull())
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
    pieces = F.zip_with(F.slice(ts, F.lit(1), F.size(ts) - 1), F.slice(ts, F.lit(2), F.size(ts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inside = F.aggregate(pieces, F.lit(0.0), lambda s, p: s + F.when(contains_sides(of, x0 + dx * (p["a"] + p["b"]) / 2, y0 + dy * (p["a"] + p["b"]) / 2), p["b"] - p["a"]).otherwise(0.0))
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(inside)


def bounds(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def tiles(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """array<struct<tx, ty>> of the tiles that a box touches."""
    cell = lambda c: F.floor(c / size)
    return F.flatten(F.transform(F.sequence(cell(x0), cell(x1)), lambda tx: F.transform(F.sequence(cell(y0), cell(y1)), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))))


def curve_place(x: Column, y: Column, x0: float, y0: float, wide: float) -> Column:
    """Place of a point along a space-filling curve (Morton's) of 2^16 steps a side, over the square of that width from (x0, y0)."""

    def spread(c: Column, low: float) -> Column:
        bits = F.floor((c - F.lit(low)) / wide * 65535).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return bits

    return spread(x, x0).bitwiseOR(F.shiftleft(spread(y, y0), 1))


def within_box(x0: Column, y0: Column, x1: Column, y1: Column, left: Column, low: Column, size: float) -> tuple[Column, Column]:
    """Where along a segment (0 to 1) it enters and leaves a square; none of it is inside unless the second is greater."""
    enter, leave = F.lit(0.0), F.lit(1.0)
    for a, b, edge in ((x0, x1, left), (y0, y1, low)):
        step = b - a
        safe = F.when(step == 0, F.lit(1.0)).otherwise(step)
        one, two = (edge - a) / safe, (edge + size - a) / safe
        inside = (a >= edge) & (a < edge + size)
        enter = F.greatest(enter, F.when(step != 0, F.least(one, two)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0)))
        leave = F.least(leave, F.when(step != 0, F.greatest(one, two)).otherwise(F.lit(1.0)))
    return enter, leave


def shared_area(one: Column, two: Column) -> Column:
    """Area that two polygons, given by their sides, have in common; neither needs to be convex.

    Lines across at all corners and crossings leave strips in which no sides cross, so a strip's part is
    its height times what both cover along its middle.
    """

    def met(e: Column, g: Column) -> Column:
        a, b, c, d = e["a"], e["b"], g["a"], g["b"]
        det = (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])
        t = ((c["x"] - a["x"]) * (d["y"] - c["y"]) - (c["y"] - a["y"]) * (d["x"] - c["x"])) / F.when(det == 0, F.lit(1.0)).otherwise(det)
        return F.when((det != 0) & (t > 0) & (t < 1), a["y"] + t * (b["y"] - a["y"]))

    def spans(of: Column, y: Column) -> Column:
        at = lambda e: F.when((e["a"]["y"] > y) != (e["b"]["y"] > y), e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.when(e["b"]["y"] == e["a"]["y"], F.lit(1.0)).otherwise(e["b"]["y"] - e["a"]["y"]))
        xs = F.array_sort(F.filter(F.transform(of, at), lambda x: x.isNotNull()))
        pairs = F.zip_with(xs, F.slice(F.concat(xs, F.array(F.lit(None).cast("double"))), F.lit(2), F.size(xs)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.filter(pairs, lambda _, i: i % 2 == 0)

    corners = lambda of: F.transform(of, lambda e: e["a"]["y"])
    crossed = F.filter(F.flatten(F.transform(one, lambda e: F.transform(two, lambda g: met(e, g)))), lambda y: y.isNotNull())
    ys = F.array_sort(F.array_distinct(F.concat(corners(one), corners(two), crossed)))
    strips = F.zip_with(F.slice(ys, F.lit(1), F.greatest(F.size(ys) - 1, F.lit(0))), F.slice(ys, F.lit(2), F.greatest(F.size(ys) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def common(strip: Column) -> Column:
        y, zero = (strip["a"] + strip["b"]) / 2, F.lit(0.0)
        both = F.flatten(F.transform(spans(one, y), lambda p: F.transform(spans(two, y), lambda q: F.greatest(zero, F.least(p["b"], q["b"]) - F.greatest(p["a"], q["a"])))))
        return (strip["b"] - strip["a"]) * F.aggregate(both, zero, lambda s, v: s + v)

    return F.aggregate(F.transform(strips, common), F.lit(0.0), lambda s, v: s + v)


def half(points: Column, axis: str, limit: Column, above: bool) -> Column:
    """The part of a ring on one side of a line across ``axis`` (Sutherland-Hodgman); empty if nothing is left. Parts of a ring that is not convex hang together by sides along the line, which leaves areas and what lies off the line right."""
    other, sign = ("y" if axis == "x" else "x"), (1 if above else -1)
    inside = lambda p: (p[axis] - limit) * sign >= 0

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        step = F.when(b[axis] == a[axis], F.lit(1.0)).otherwise(b[axis] - a[axis])
        at = a[other] + (b[other] - a[other]) * (limit - a[axis]) / step
        meet = F.struct(*[(limit if n == axis else at).cast("double").alias(n) for n in "xy"])
        return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(meet)).when(inside(b), F.array(meet, b)).otherwise(F.slice(F.array(b), 1, 0))

    return F.flatten(F.transform(edges(points), cut))


def albers(lon: Column, lat: Column, lat1: float = 34.0, lat2: float = 40.5, lat0: float = 0.0, lon0: float = -120.0, false_north: float = -4_000_000.0) -> tuple[Column, Column]:
    """Albers equal-area metres on the GRS 80 ellipsoid (defaults: EPSG:3310)."""
    import math

    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q(s):  # noqa: ANN001, ANN202  s: sine of the latitude
        log = F.log if isinstance(s, Column) else math.log
        return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - e2 * math.sin(math.radians(d)) ** 2)
    sine = lambda d: math.sin(math.radians(d))
    n = (m(lat1) ** 2 - m(lat2) ** 2) / (q(sine(lat2)) - q(sine(lat1)))
    c = m(lat1) ** 2 + n * q(sine(lat1))
    rho0 = a * math.sqrt(c - n * q(sine(lat0))) / n
    rho = F.sqrt(F.lit(c) - F.lit(n) * q(F.sin(F.radians(lat)))) * (a / n)
    theta = F.radians(lon - lon0) * n
    return rho * F.sin(theta), F.lit(rho0 + false_north) - rho * F.cos(theta)
