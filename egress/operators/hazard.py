"""Hazard layers over road segments, and the exits that rules leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.functions import geo
from egress.operators.spatial import near_polygons, pieces
from egress.plans.store import shuffle_parts


def overlay_polygons(segments: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """(eid, level, share): part of each segment (eid, x0, y0, x1, y1) inside the polygons (level, and rings or ring) of a level, 1 at most.

    Segments and polygons meet on tiles, both cut: a tile holds the part of the segment within
    it and the part of the polygon in and half a tile around it, so a ring of many vertices is
    never tested whole. Polygons are not merged, so the tiles stay selective. Levels of share
    0 are left out.
    """
    dealt = segments.repartition(shuffle_parts(segments.sparkSession), "eid")  # a small file of segments would be one task's
    left = dealt.withColumn("tile", F.explode(geo.tiles(F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"), size)))
    low, high = geo.within_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("tile.tx") * size, F.col("tile.ty") * size, size)
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    left = left.withColumns({"low": low, "high": high}).filter("high > low")
    parts = left.select("eid", "tile", (F.col("high") - F.col("low")).alias("part"), at("x0", "x1", "low").alias("xa"), at("y0", "y1", "low").alias("ya"), at("x0", "x1", "high").alias("xb"), at("y0", "y1", "high").alias("yb"))
    box = F.struct(*[c.alias(k) for k, c in geo.bounds(F.flatten("piece")).items()]).alias("box")
    right = pieces(polygons, size, size / 2, whole=True).select("tile", "about.level", F.explode(F.array(geo.sides(F.col("piece")))).alias("sides"), box)
    meets = [F.least(f"{c}a", f"{c}b") <= F.col(f"box.{c}1") for c in "xy"] + [F.greatest(f"{c}a", f"{c}b") >= F.col(f"box.{c}0") for c in "xy"]
    shares = parts.join(right, "tile").filter(meets[0] & meets[1] & meets[2] & meets[3]).withColumn("share", F.col("part") * geo.share_inside(*[F.col(c) for c in ("xa", "ya", "xb", "yb")], F.col("sides")))
    return shares.groupBy("eid", "level").agg(F.least(F.sum("share"), F.lit(1.0)).alias("share")).filter("share > 0")


def overlay_raster(segments: DataFrame, pixels: DataFrame, cell: float, bins: list[float], step: float) -> DataFrame:
    """(eid, level, share): part of evenly spaced samples (ends included) whose pixel value falls in each bin; level 0 is below the first bound or without data.

    Pixels (row, col, value) join on the sample's cell.
    """
    long = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    n = F.greatest(F.lit(2), F.floor(long / step).cast("int") + 1)
    samples = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("i") / (F.col("n") - 1)
    at = samples.select("eid", "n", F.floor((F.col("y0") + t * (F.col("y1") - F.col("y0"))) / cell).alias("row"), F.floor((F.col("x0") + t * (F.col("x1") - F.col("x0"))) / cell).alias("col"))
    level = sum((F.when(F.col("value") >= b, 1).otherwise(0) for b in bins), F.lit(0))
    return at.join(pixels, ["row", "col"], "left").groupBy("eid", "n", level.alias("level")).agg(F.count("*").alias("k")).select("eid", "level", (F.col("k") / F.col("n")).alias("share"))


def shares_wide(segments: DataFrame, shares: DataFrame, levels: list[int]) -> DataFrame:
    """One row per segment: hazard_max (0 if free) and hazard_share_<level>."""
    wide = shares.groupBy("eid").pivot("level", levels).agg(F.sum("share"))
    named = wide.select("eid", *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"hazard_share_{k}") for k in levels])
    out = segments.select("eid").join(named, "eid", "left").na.fill(0.0)
    top = F.greatest(F.lit(0), *[F.when(F.col(f"hazard_share_{k}") > 0, k).otherwise(0) for k in levels])
    return out.select("eid", top.cast("int").alias("hazard_max"), *[f"hazard_share_{k}" for k in levels])


def rule_targets(nodes: DataFrame, classes: list[str], free_of: DataFrame | None = None, away_from: tuple[Column, float] | None = None) -> DataFrame:
    """(vid): nodes on any of the classes, not in ``free_of`` (vid in hazard), and at least so far from a place."""
    out = nodes.filter(" OR ".join(f"on_{c}" for c in classes))
    if free_of is not None:
        out = out.join(free_of.select("vid"), "vid", "left_anti")
    if away_from is not None:
        out = out.filter(away_from[0] >= away_from[1])
    return out.select("vid")


def targets_away(targets: DataFrame, communities: DataFrame, least: float, size: float) -> DataFrame:
    """(unit, vid): for each community (unit, rings or ring) those of the targets (vid, x, y) at least so far from its polygon."""
    near = near_polygons(targets.select("vid", "x", "y"), communities, least, size).filter(F.col("distance") < least)
    units = communities.select("unit").distinct()
    every = targets.select("vid").withColumn("unit", F.explode(F.array(*[F.lit(r["unit"]) for r in units.collect()])))
    return every.join(near.select("unit", "vid").distinct(), ["unit", "vid"], "left_anti").select("unit", "vid")


def without_hazard(arcs: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """(unit, eid): arcs that are left when those of hazard ``least`` or more go. A null unit stands for all units; an arc of hazard stays for a unit if both its ends are among the unit's members (unit, vid)."""
    free = arcs.filter(F.col("hazard_max") < least).select(F.lit(None).cast(members.schema["unit"].dataType).alias("unit"), "eid")
    ends = members.withColumnRenamed("vid", "src").join(arcs.filter(F.col("hazard_max") >= least).select("eid", "src", "dst"), "src")
    inside = ends.join(members.withColumnRenamed("vid", "dst"), ["unit", "dst"], "left_semi").select("unit", "eid")
    return free.union(inside)
