"""Spatial joins as equi-joins on tiles with an exact test on the pairs that share one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.functions import geo
from egress.plans.store import released, written


def rings_of(polygons: DataFrame) -> Column:
    """Rings of polygons: their column ``rings``, or ``ring`` as the only one."""
    return F.col("rings") if "rings" in polygons.columns else F.array("ring")


#: Corners and tiles up to which a polygon may stay whole.
WHOLE, WHOLE_TILES = 32, 64


def pieces(polygons: DataFrame, size: float, margin: float = 0.0, reach: float = 0.0, whole: bool = False) -> DataFrame:
    """(about, tile, piece): the part of each polygon (rings or ring, others in ``about``) in each tile of its box and ``margin`` around it, where any is left; the box is ``reach`` larger on all sides.

    A polygon is halved at tile borders until each part lies in one tile, first across x, then
    across y; so a vertex is looked at once for each halving, not once for each tile. With
    ``whole``, for users who need no border at the margin, a polygon of few corners and tiles
    is handed to each tile of its box as it is.
    """
    rest = [c for c in polygons.columns if c not in ("ring", "rings")]
    about = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("string")
    rows = polygons.select(about.alias("about"), F.filter(rings_of(polygons), lambda r: F.size(r) > 2).alias("piece"))
    box = geo.bounds(F.flatten("piece"))
    cell = lambda c: F.floor((box[c] + (reach if c.endswith("1") else -reach)) / size)
    rows = rows.filter(F.size("piece") > 0).withColumns({"tx": cell("x0"), "tx1": cell("x1"), "ty": cell("y0"), "ty1": cell("y1")})
    small = None
    if whole:
        few = (F.size(F.flatten("piece")) <= WHOLE) & ((F.col("tx1") - F.col("tx") + 1) * (F.col("ty1") - F.col("ty") + 1) <= WHOLE_TILES)
        few = F.coalesce(few, F.lit(False))
        across = rows.filter(few).select("about", "ty", "ty1", "piece", F.explode(F.sequence("tx", "tx1")).alias("tx"))
        small = across.select("about", "tx", "piece", F.explode(F.sequence("ty", "ty1")).alias("ty")).select("about", F.struct("tx", "ty").alias("tile"), "piece")
        rows = rows.filter(~few)
        if rows.isEmpty():
            return small
    spans = rows.agg(F.max(F.col("tx1") - F.col("tx")).alias("x"), F.max(F.col("ty1") - F.col("ty")).alias("y")).first()
    for axis in "xy":
        low, high = f"t{axis}", f"t{axis}1"
        for _ in range(int(spans[axis] or 0).bit_length()):
            mid = F.floor((F.col(low) + F.col(high)) / 2)
            line = (mid + 1) * size
            part = lambda above, limit: F.transform("piece", lambda r: geo.half(r, axis, limit, above))  # noqa: B023, E731
            one = F.struct(F.col(low).alias("low"), mid.alias("high"), part(False, line + margin).alias("piece"))
            two = F.struct((mid + 1).alias("low"), F.col(high).alias("high"), part(True, line - margin).alias("piece"))
            same = F.struct(F.col(low).alias("low"), F.col(high).alias("high"), F.col("piece").alias("piece"))
            keep = [c for c in rows.columns if c not in (low, high, "piece")]
            split = rows.select(*keep, F.explode(F.when(F.col(low) < F.col(high), F.array(one, two)).otherwise(F.array(same))).alias("h"))
            rows = split.select(*keep, F.col("h.low").alias(low), F.col("h.high").alias(high), F.filter("h.piece", lambda r: F.size(r) > 2).alias("piece")).filter(F.size("piece") > 0)
    cut = rows.select("about", F.struct("tx", "ty").alias("tile"), "piece")
    return cut if small is None else small.unionByName(cut)


def points_in(points: DataFrame, polygons: DataFrame, size: float, how: str = "inner", strict: bool = True) -> DataFrame:
    """Points (x, y, ...) with the columns of the polygons (rings or ring, ...) that hold them. A polygon is cut at tiles, a point goes to its own; several polygons give several rows."""
    test: Callable = geo.contains_sides if strict else geo.covers_sides
    right = pieces(polygons, size, size / 2, whole=True)
    tile = F.struct(F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty"))
    left = points.select(F.struct("*").alias("point"), tile.alias("tile"))
    match = (left["tile"] == right["tile"]) & test(geo.sides(F.col("piece")), F.col("point.x"), F.col("point.y"))
    joined = left.join(right.hint("merge"), match, how)  # sizes of files say little about those of rings in memory
    rest = [] if "semi" in how or "anti" in how else [c for c in polygons.columns if c not in ("ring", "rings")]
    return joined.select(*[F.col(f"point.`{c}`").alias(c) for c in points.columns], *[F.col(f"about.`{c}`").alias(c) for c in rest])


def burn_shares(areas: DataFrame, fires: DataFrame, size: float) -> DataFrame:
    """(area, fire, share): part of each area (area, rings or ring) within each fire (fire, rings or ring); pairs that share nothing are left out.

    Polygons of few corners and tiles are compared whole, in the tile where both boxes begin. Others are cut
    at tiles, and what they have in common is added up over the tiles where they meet. Rings of one polygon must not cross.
    """
    one, many_one = _by_size(areas, "area", size)
    two, many_two = _by_size(fires, "fire", size)
    first = lambda c: F.floor(F.greatest(f"one.{c}0", f"two.{c}0") / size) == F.col(f"tile.t{c}")
    pairs = one.withColumnRenamed("it", "one").join(two.withColumnRenamed("it", "two").hint("merge"), "tile").filter(_boxes_meet(F.col("one"), F.col("two"), 0.0) & first("x") & first("y"))
    common = pairs.select("one.area", "two.fire", geo.shared_area(F.col("one.sides"), F.col("two.sides")).alias("common"))
    for left, right in ((many_one, fires), (None if many_two is None else one.select("it.area", "it.rings").distinct(), many_two)):
        if left is not None and right is not None:
            ones = pieces(left, size).select("about.area", "tile", F.explode(F.array(geo.sides(F.col("piece")))).alias("one"))
            twos = pieces(right, size).select("about.fire", "tile", F.explode(F.array(geo.sides(F.col("piece")))).alias("two"))
            common = common.unionByName(ones.join(twos.hint("merge"), "tile").select("area", "fire", geo.shared_area(F.col("one"), F.col("two")).alias("common")))
    whole = areas.select("area", geo.polygon_area(geo.oriented(rings_of(areas))).alias("whole")).filter("whole > 0")
    sums = common.groupBy("area", "fire").agg(F.sum("common").alias("common")).filter("common > 0")
    return sums.join(whole.hint("merge"), "area").select("area", "fire", F.least(F.col("common") / F.col("whole"), F.lit(1.0)).alias("share"))


def _by_size(polygons: DataFrame, key: str, size: float) -> tuple[DataFrame, DataFrame | None]:
    """(tile, it) of polygons (key, rings or ring) of few corners and tiles, once for each tile of their box, ``it`` with key, rings, sides and box; the others (key, rings), None if there are none."""
    rows = polygons.select(key, F.filter(rings_of(polygons), lambda r: F.size(r) > 2).alias("rings")).filter(F.size("rings") > 0)
    rows = rows.withColumns(geo.bounds(F.flatten("rings")))
    cells = {c: F.floor(F.col(c) / size) for c in ("x0", "x1", "y0", "y1")}
    few = F.coalesce((F.size(F.flatten("rings")) <= WHOLE) & ((cells["x1"] - cells["x0"] + 1) * (cells["y1"] - cells["y0"] + 1) <= WHOLE_TILES), F.lit(False))
    it = F.struct(key, "rings", geo.sides(F.col("rings")).alias("sides"), "x0", "x1", "y0", "y1").alias("it")
    small = rows.filter(few).select(it, F.explode(geo.tiles(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)).alias("tile"))
    large = rows.filter(~few).select(key, "rings")
    return small, None if large.isEmpty() else large


def _boxes_meet(a: Column, b: Column, most: float) -> Column:
    """Whether two boxes (structs with x0, x1, y0, y1) share a point or lie at most so far apart along each axis."""
    return (a["x0"] <= b["x1"] + most) & (b["x0"] <= a["x1"] + most) & (a["y0"] <= b["y1"] + most) & (b["y0"] <= a["y1"] + most)


def near_polygons(points: DataFrame, polygons: DataFrame, most: float, size: float) -> DataFrame:
    """Points (x, y, ...) with the columns of the polygons (rings or ring, ...) that lie at most ``most`` away, and ``distance``: 0 inside or on the border.

    A tile holds what of a polygon lies within that distance around it, so the sides at its
    edge that cutting made are farther than any that count.
    """
    right = pieces(polygons, size, most * 1.001 + 1e-9, most, whole=True)
    tile = F.struct(F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty"))
    left = points.select(F.struct("*").alias("point"), tile.alias("tile"))
    x, y, sides = F.col("point.x"), F.col("point.y"), geo.sides(F.col("piece"))
    far = F.when(geo.covers_sides(sides, x, y), 0.0).otherwise(geo.distance_to_sides(sides, x, y))
    joined = left.join(right, "tile").select("point", "about", far.alias("distance")).filter(F.col("distance") <= most)
    rest = [c for c in polygons.columns if c not in ("ring", "rings")]
    return joined.select(*[F.col(f"point.`{c}`").alias(c) for c in points.columns], *[F.col(f"about.`{c}`").alias(c) for c in rest], "distance")


def meeting(ones: DataFrame, twos: DataFrame, size: float, most: float = 0.0) -> DataFrame:
    """(one, two): the pairs of polygons that share a point, or lie at most ``most`` apart; structs of their columns other than ring and rings.

    Both are cut at tiles with what lies around them kept, so the sides that cutting made lie
    outside the tile. Polygons meet where sides do, or a corner of one lies in the other; the
    least distance of others is from a corner of one to a side of the other. A corner and a
    crossing count in the tile that they lie in, so a corner meets the nearby sides alone.
    Pairs whose boxes are farther apart than that are left out before any side is looked at.
    """
    margin = max(size / 2, most * 1.001 + 1e-9)
    slack = size * 1e-9

    def here(x: Column, y: Column) -> Column:
        low = [F.col(f"tile.{c}") * size - slack for c in ("tx", "ty")]
        return (x >= low[0]) & (x <= low[0] + size + 2 * slack) & (y >= low[1]) & (y <= low[1] + size + 2 * slack)

    def cut(polygons: DataFrame, name: str) -> DataFrame:
        found = pieces(polygons, size, margin, most, whole=True).withColumn("side", F.explode(F.array(geo.sides(F.col("piece")))))
        own = F.filter(F.flatten("piece"), lambda p: here(p["x"], p["y"]))
        box = F.struct(*[c.alias(k) for k, c in geo.bounds(F.flatten("piece")).items()])
        return found.select("tile", F.col("about").alias(name), F.col("side").alias(f"{name}_sides"), own.alias(f"{name}_corners"), box.alias(f"{name}_box"))

    def crosses(e: Column, g: Column) -> Column:
        x, y, t, u = geo.crossing(e, g)
        return F.coalesce((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1) & here(x, y), F.lit(False))

    def reaches(corners: str, sides: str) -> Column:
        of = F.col(sides)
        near = lambda p: geo.covers_sides(of, p["x"], p["y"]) | (geo.distance_to_sides(of, p["x"], p["y"]) <= most)
        return F.exists(corners, near)

    both = cut(ones, "one").join(cut(twos, "two").hint("merge"), "tile").filter(_boxes_meet(F.col("one_box"), F.col("two_box"), most * 1.001 + slack + 1e-9))
    touch = reaches("one_corners", "two_sides") | reaches("two_corners", "one_sides") | F.exists("one_sides", lambda e: F.exists("two_sides", lambda g: crosses(e, g)))
    return both.filter(touch).select("one", "two").distinct()


def nearest(queries: DataFrame, sites: DataFrame, by: list[str], ties: str = "first") -> DataFrame:
    """(by, qid, sid, dist): the nearest site of the same group for each query point; none for a group without sites. ``ties``: first (least site id) or all.

    Queries (by, qid, x, y) and sites (by, sid, x, y) meet on tiles about twice as wide as a
    site has room in its group. A query looks at its own tile and the eight around it, and is done
    when a site is no farther than a tile is wide; the others look again on tiles four times as
    wide, so a group is never paired with itself. Null or repeated coordinates: points without
    coordinates are left out, sites at one place are ties.
    """
    placed = sites.filter("x IS NOT NULL AND y IS NOT NULL").select(*by, "sid", F.col("x").alias("sx"), F.col("y").alias("sy"))
    room = F.sqrt((F.max("sx") - F.min("sx")) * (F.max("sy") - F.min("sy")) / F.count("*"))
    wide = F.greatest(room, (F.max("sx") - F.min("sx")) / F.count("*"), (F.max("sy") - F.min("sy")) / F.count("*"))
    sizes = placed.groupBy(*by).agg(F.when(wide > 0, wide).otherwise(1.0).alias("size"))
    open_ = written(queries.filter("x IS NOT NULL AND y IS NOT NULL").select(*by, "qid", "x", "y").join(sizes, by), "nearest-open")
    placed = written(placed.join(sizes, by), "nearest-sites")
    cell = lambda c, d: F.floor(F.col(c) / (F.col("size") * grown)) + d
    parts, grown = [], 2.0
    while True:
        around = F.array(*[F.struct(cell("x", dx).alias("tx"), cell("y", dy).alias("ty")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        there = placed.select(*by, "sid", "sx", "sy", F.struct(cell("sx", 0).alias("tx"), cell("sy", 0).alias("ty")).alias("tile"))
        pairs = open_.withColumn("tile", F.explode(around)).join(there, [*by, "tile"]).withColumn("dist", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")))
        near = pairs.filter(F.col("dist") <= F.col("size") * grown)
        if ties == "first":
            found = near.groupBy(*by, "qid").agg(F.min(F.struct("dist", "sid")).alias("m")).select(*by, "qid", "m.sid", "m.dist")
        else:
            least = near.groupBy(*by, "qid").agg(F.min("dist").alias("dist"))
            found = near.select(*by, "qid", "sid", "dist").join(least, [*by, "qid", "dist"]).select(*by, "qid", "sid", "dist")
        parts.append(written(found, "nearest-found"))
        rest = written(open_.join(parts[-1].select(*by, "qid").distinct(), [*by, "qid"], "left_anti"), "nearest-open")
        released(open_)
        open_ = rest
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        grown *= 4


def within_distance(points: DataFrame, others: DataFrame, most: float) -> DataFrame:
    """(pid, oid) at most ``most`` apart. Tiles are ``most`` wide; a point looks at its own and the eight around it."""
    cell = lambda c, d: F.floor(F.col(c) / most) + d
    around = F.array(*[F.struct(cell("x", dx).alias("tx"), cell("y", dy).alias("ty")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    left = points.select("pid", "x", "y", F.explode(around).alias("tile"))
    right = others.select("oid", F.col("x").alias("ox"), F.col("y").alias("oy"), F.struct(cell("x", 0).alias("tx"), cell("y", 0).alias("ty")).alias("tile"))
    return left.join(right, "tile").filter(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= most).select("pid", "oid")


def tile_pieces(polygons: DataFrame, size: float) -> DataFrame:
    """(tx, ty, level, area, piece): polygons cut at tile borders; pieces without area are dropped."""
    whole = polygons.withColumn("rings", geo.oriented(rings_of(polygons))).drop("ring")
    cut = pieces(whole, size).select("tile.tx", "tile.ty", "about.level", geo.polygon_area(F.col("piece")).alias("area"), "piece")
    return cut.filter("area > 0")
