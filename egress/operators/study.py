"""Study areas: from layers of counties, fires, areas, zones and blocks to the tables that rankings and policies take.

Layers are polygons (rings or ring, and columns of their own) in one plane. An area around some
core is never built as a polygon: what lies at most so far from any core polygon is in it.
``size`` is the width of the tiles that polygons are cut at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.functions.roads import VEHICLE_CODES, plain_place, vehicles
from egress.operators.hazard import overlay_polygons, shares_wide
from egress.operators.spatial import burn_shares, meeting, points_in, rings_of
from egress.plans.store import written
from egress.sources.roads import write_sorted


def _whole(polygons: DataFrame) -> DataFrame:
    """Polygons with ``rings`` alone."""
    return polygons.withColumn("rings", rings_of(polygons)).drop("ring")


def dissolved(polygons: DataFrame, by: list[str], order: str) -> DataFrame:
    """One polygon for each value of ``by``: the rings of all its rows, which must not overlap, and the other columns of its first row by ``order``."""
    whole = _whole(polygons)
    rest = [c for c in whole.columns if c not in (*by, "rings")]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("first")
    rows = whole.groupBy(*by).agg(first, F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "rings"))), lambda x: x["rings"])).alias("rings"))
    return rows.select(*by, *[F.col(f"first.`{c}`").alias(c) for c in rest], "rings")


def fire_perimeter(perimeters: DataFrame, name: str, year: int, unit: str) -> DataFrame:
    """The perimeters (fire_name, year, unit_id) of one fire."""
    return perimeters.filter((F.col("fire_name") == name) & (F.col("year") == year) & (F.col("unit_id") == unit))


def clusters(areas: DataFrame, fires: DataFrame, size: float) -> DataFrame:
    """Each area (area, ...) once for each fire (fire, ...) that it meets, with ``cluster`` (the fire) and ``burn_share``, the part of it inside; 0 if they only touch."""
    one, two = written(_whole(areas), "study-areas"), written(_whole(fires), "study-fires")
    met = meeting(one.select("area", "rings"), two.select("fire", "rings"), size).select("one.area", "two.fire")
    shares = burn_shares(one.select("area", "rings"), two.select("fire", "rings"), size)
    told = met.join(shares.hint("merge"), ["area", "fire"], "left").select("area", F.col("fire").alias("cluster"), F.coalesce("share", F.lit(0.0)).alias("burn_share"))
    return told.join(one.hint("merge"), "area")


def within(polygons: DataFrame, core: DataFrame, size: float, most: float = 0.0) -> DataFrame:
    """The polygons (id, ...) that meet a polygon of the core, or lie at most ``most`` from one."""
    whole = written(_whole(polygons), "study-polygons")
    met = meeting(whole.select("id", "rings"), _whole(core).select("rings"), size, most).select("one.id").distinct()
    return whole.join(met.hint("merge"), "id", "left_semi")


def hazard_zones(layers: dict[str, DataFrame], core: DataFrame, size: float, most: float) -> DataFrame:
    """(id, level, source_map, rings): zones (level, ...) of all layers in the study area. Levels below 1 are no hazard. ``id`` is the layer's name and the zone's id."""
    parts = [_whole(df).select(F.struct(F.lit(name).alias("layer"), F.col("id").alias("zone")).alias("id"), "level", F.lit(name).alias("source_map"), "rings") for name, df in sorted(layers.items())]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return within(every.filter("level >= 1"), core, size, most)


#: Fixed prefixes of statistical areas' labels.
AREA_PREFIX = r"^(Los Angeles|Unincorporated|City of) -? ?"


def communities(kind: str, polygons: DataFrame, size: float, county: DataFrame | None = None, fires: DataFrame | None = None) -> DataFrame:
    """(cid, name, label, kind, ..., rings) by kind of layer.

    places: those (id, name, label, class) that meet the county; a class that begins with C is
    incorporated. areas: those (area, label, kind, ...) that a fire met, once for each fire,
    with cluster and burn_share, the label's prefix cut off their name.
    """
    if kind == "places" and county is not None:
        kinds = F.when(F.startswith("class", F.lit("C")), "incorporated").otherwise("CDP")
        return within(polygons, county, size).select(F.col("id").alias("cid"), "name", "label", kinds.alias("kind"), "rings")
    if kind == "areas" and fires is not None:
        name = F.regexp_replace("label", AREA_PREFIX, "")
        return clusters(polygons, fires, size).select(F.col("area").alias("cid"), name.alias("name"), "label", "kind", "cluster", "burn_share", "rings")
    raise ValueError(f"unknown kind of communities {kind!r}, or its county or fires are missing")


def populated(places: DataFrame, blocks: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """(places with pop and housing, one row (pop, outside) of all people and of those in no place) of blocks (x, y, pop, housing), each counted where its point lies strictly inside; places without blocks have 0."""
    places = written(places, "study-places")
    own = _whole(places).select("cid", "rings").dropDuplicates(["cid"])  # a place that two fires met is one polygon
    placed = written(points_in(blocks.select("block", "x", "y", "pop", "housing"), own, size, "left"), "study-blocks")
    sums = placed.filter("cid IS NOT NULL").groupBy("cid").agg(F.sum("pop").alias("pop"), F.sum("housing").alias("housing"))
    single = placed.groupBy("block").agg(F.max("pop").alias("pop"), F.max("cid").isNull().alias("out"))
    told = single.agg(F.sum("pop").alias("pop"), F.coalesce(F.sum(F.when(F.col("out"), F.col("pop"))), F.lit(0)).alias("outside"))
    return places.join(sums.hint("merge"), "cid", "left").na.fill(0, ["pop", "housing"]), told


def burned_groups(places: DataFrame, least: float) -> DataFrame:
    """(cluster, cid, name): populated places of each cluster of which the fire took at least such a part: those to evacuate as one group."""
    return places.filter((F.col("pop") > 0) & (F.col("burn_share") >= least)).select("cluster", "cid", "name")


def prefire_vehicles(table: DataFrame, names: DataFrame, counts: dict[int, Column] | None = None) -> DataFrame:
    """(name, place, population, vehicles) of the named places in a table of texts (name, place, population, a count of households by code).

    Codes are columns B25044_001E and so on unless ``counts`` says otherwise. Names lose state and legal suffix first.
    """
    found = {k: F.expr(f"try_cast(B25044_{k:03d}E AS double)") for k in VEHICLE_CODES} if counts is None else counts
    rows = table.select(plain_place(F.col("name")).alias("name"), "place", F.expr("try_cast(population AS double)").cast("long").alias("population"), vehicles(found).alias("vehicles"))
    return rows.join(names.select("name").distinct(), "name", "left_semi").select("name", "place", "population", "vehicles")


def prepare(segments: DataFrame, zones: DataFrame, places: DataFrame, county: DataFrame, path: str, size: float, levels: list[int]) -> DataFrame:
    """(hazard_max, n): how many segments (eid, x0, y0, x1, y1, ...) reach each level of the zones (level, ...), once the layers of a study area are written.

    Under ``path``: edges (segments with hazard_max and a share for each level), and zones,
    communities and county as layers that a box reads in part (:func:`egress.sources.roads.write_sorted`).
    """
    shares = shares_wide(segments, overlay_polygons(segments, zones, size), levels)
    segments.join(shares, "eid").write.mode("overwrite").parquet(f"{path}/edges")
    for name, layer in {"zones": zones, "communities": places, "county": county}.items():
        write_sorted(layer, f"{path}/{name}")
    return segments.sparkSession.read.parquet(f"{path}/edges").groupBy("hazard_max").agg(F.count("*").alias("n"))


def units(places: DataFrame, groups: DataFrame, fires: DataFrame, without: str) -> DataFrame:
    """(unit, kind, pop, vehicles, even_weights, cids): what policies are worked out for.

    Each populated place (cid, name, pop) whose name doesn't contain ``without`` is a community;
    each group (fire, name) of which every name is a place is a fire_group, with the vehicles and
    weights of its row in ``fires`` (fire, vehicles, even_weights) and no population.
    """
    one = places.filter((F.col("pop") > 0) & ~F.contains("name", F.lit(without)))
    alone = one.select(F.col("name").alias("unit"), F.lit("community").alias("kind"), "pop", F.lit(None).cast("double").alias("vehicles"), F.lit(False).alias("even_weights"), F.array("cid").alias("cids"))
    named = groups.join(places.select("name", "cid"), "name", "left")
    whole = named.groupBy("fire").agg(F.bool_and(F.col("cid").isNotNull()).alias("known"), F.array_sort(F.collect_set("cid")).alias("cids")).filter("known")
    group = whole.join(fires, "fire").select(F.concat("fire", F.lit(" group")).alias("unit"), F.lit("fire_group").alias("kind"), F.lit(None).cast(places.schema["pop"].dataType).alias("pop"), F.col("vehicles").cast("double").alias("vehicles"), "even_weights", "cids")
    return alone.unionByName(group)


def unit_rings(listed: DataFrame, places: DataFrame) -> DataFrame:
    """(unit, rings) of units (unit, cids): the rings of all their places (cid, ring or rings)."""
    own = _whole(places).select("cid", "rings").dropDuplicates(["cid"])
    rows = listed.select("unit", F.explode("cids").alias("cid")).join(own, "cid")
    return dissolved(rows.select("unit", "cid", "rings"), ["unit"], "cid").select("unit", "rings")


def refreshed(table: DataFrame, fresh: DataFrame, prefix: str, key: str = "unit") -> DataFrame:
    """``table`` with the columns that start with ``prefix`` taken from ``fresh`` instead; rows without news have nulls there."""
    kept = table.drop(*[c for c in table.columns if c.startswith(prefix)])
    return kept.join(fresh.select(key, *[c for c in fresh.columns if c.startswith(prefix)]), key, "left")


def extra_km(arcs: DataFrame) -> DataFrame:
    """One row (arcs, km): extra roads (is_extra), a road being about two arcs."""
    return arcs.filter("is_extra").agg(F.count("*").alias("arcs"), (F.coalesce(F.sum("length_m"), F.lit(0.0)) / 2000).alias("km"))


# --- what figures are drawn from ---------------------------------------------------------------


def exit_classes(table: DataFrame) -> DataFrame:
    """(cls, n, population) of a ranking (cut_off, capacity_vph, capacity_free, pop): 0 has no way out without the hazard, 1 less capacity without it, 2 as much."""
    cls = F.when(F.col("cut_off"), 0).when(F.col("capacity_free") < F.col("capacity_vph"), 1).otherwise(2)
    return table.groupBy(cls.alias("cls")).agg(F.count("*").alias("n"), F.sum("pop").cast("long").alias("population"))


def timeline(table: DataFrame, start: float, bars: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(unit, k, label, start, hours, least_hours, ends): a bar for each label in order, from ``start`` for as long as its column says; with a second column, the hours under kinder assumptions."""
    each = [F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), F.col(h).cast("double").alias("hours"), (F.lit(None) if low is None else F.col(low)).cast("double").alias("least_hours")) for k, (label, (h, low)) in enumerate(bars.items())]
    rows = table.select("unit", F.explode(F.array(*each)).alias("b"))
    return rows.select("unit", "b.k", "b.label", F.lit(start).alias("start"), "b.hours", "b.least_hours", (F.lit(start) + F.col("b.hours")).alias("ends"))
