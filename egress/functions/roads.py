"""Road attributes as column expressions: lanes, capacities, tag filters, labels, clock times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed tag values outside a drivable network, searched anywhere in the value.
NOT_DRIVEN = {
    "highway": "abandoned|bridleway|bus_guideway|construction|corridor|cycleway|elevator|escalator|footway|no|path|pedestrian|planned|platform|proposed|raceway|razed|rest_area|service|steps|track",
    "area": "yes",
    "access": "private",
    "motor_vehicle": "no",
    "motorcar": "no",
    "service": "alley|driveway|emergency_access|parking|parking_aisle|private",
}


def lanes(tag: Column) -> Column:
    """Least number in a lanes tag such as '2' or '3;2'; null if it has none."""
    return F.array_min(F.transform(F.regexp_extract_all(tag, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double")))


def first_of(tags: Column) -> Column:
    """First value of a list tag, as merged ways carry; null for an empty list."""
    return F.try_element_at(tags, F.lit(1))


def lanes_of_list(tags: Column) -> Column:
    """Least number in a list of lanes tags."""
    return lanes(F.array_join(tags, ";"))


def with_capacity(arcs: DataFrame, classes: DataFrame, default: tuple[float, float]) -> DataFrame:
    """lanes_dir, lanes_imputed, capacity_vph from lanes_tot, oneway, road_class.

    ``classes``: road_class, class_lanes, per_lane (one row per class, so it is broadcast);
    ``default``: lanes and capacity per lane of other classes. Two-way roads give each
    direction half the lanes, one at least.
    """
    per_direction = F.when(F.col("oneway"), F.col("lanes_tot")).otherwise(F.floor(F.col("lanes_tot") / 2).cast("double"))
    tagged = F.when(F.col("lanes_tot").isNull(), F.lit(None)).otherwise(F.greatest(per_direction, F.lit(1.0)))
    joined = arcs.join(F.broadcast(classes), "road_class", "left")
    out = joined.withColumn("lanes_imputed", F.col("lanes_tot").isNull()).withColumn("lanes_dir", F.coalesce(tagged, "class_lanes", F.lit(default[0])))
    return out.withColumn("capacity_vph", F.col("lanes_dir") * F.coalesce("per_lane", F.lit(default[1]))).drop("class_lanes", "per_lane")


def drivable(tags: dict[str, Column]) -> Column:
    """Whether a way has a highway tag and none of its tags excludes it; other missing tags exclude nothing."""
    out = tags["highway"].isNotNull()
    for key, pattern in NOT_DRIVEN.items():
        if key in tags:
            out = out & ~F.rlike(F.coalesce(tags[key], F.lit("")), F.lit(pattern))
    return out


def extra_road(tags: dict[str, Column], highways: list[str], not_services: list[str], not_tracktypes: list[str]) -> Column:
    """Whether a way is one of the extra road kinds, not an area ('yes' anywhere in the tag), and of no excluded service or track type."""
    own = lambda key: F.coalesce(tags.get(key, F.lit("")), F.lit(""))
    return F.coalesce(tags["highway"].isin(highways), F.lit(False)) & ~F.contains(own("area"), F.lit("yes")) & ~own("service").isin(not_services) & ~own("tracktype").isin(not_tracktypes)


def road_key(name: Column, ref: Column) -> Column:
    """Name, else reference, else null; the text 'nan' stands for a missing value."""
    return F.coalesce(F.nullif(name, F.lit("nan")), F.nullif(ref, F.lit("nan")))


def clock(hours: Column) -> Column:
    """Hours since midnight as HH:MM, halves of a minute to the even one; hours go on after 24."""
    minutes = F.bround(hours * 60, 0).cast("long")
    return F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)


def plain_place(name: Column) -> Column:
    """A place's name up to the first comma and without its legal suffix, trimmed."""
    return F.trim(F.regexp_replace(F.split(name, ",")[0], r" (city|town|CDP)$", ""))


#: Fixed columns of the vehicle table B25044: owners' and renters' households by vehicles (5 stands for 5 and more).
VEHICLE_CODES = {3: 0, 4: 1, 5: 2, 6: 3, 7: 4, 8: 5, 10: 0, 11: 1, 12: 2, 13: 3, 14: 4, 15: 5}


def vehicles(counts: dict[int, Column]) -> Column:
    """Vehicles from the table's columns by code (see VEHICLE_CODES); null if any count is missing."""
    return sum((counts[code].cast("double") * k for code, k in VEHICLE_CODES.items()), F.lit(0.0))


def finite_ratio(num: Column, den: Column) -> Column:
    """num / den, infinite where den is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(float("inf")))
