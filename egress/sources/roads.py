"""Readers of road networks, hazards, blocks and vehicles; all lazy, all through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from egress.functions.geo import bounds, covers, curve_place
from egress.functions.ranks import ranked
from egress.functions.roads import NOT_DRIVEN, drivable, extra_road
from egress.operators.graph import dealt, undirected_unique
from egress.operators.spatial import near_polygons, rings_of
from egress.plans.store import shuffle_parts, written


def relabelled(pairs: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices vid, orig_id; edges src, dst) of raw pairs (a, b): undirected, distinct, without loops, ids dense in order of the original ones. ``parts``: how many parts large steps are dealt out to, else Spark's choice."""
    edges = undirected_unique(pairs, parts)
    ids = dealt(pairs.filter("a != b").select(F.explode(F.array("a", "b")).alias("orig_id")), parts, "orig_id").distinct()
    vertices = ranked(ids, "orig_id", name="vid").select("vid", "orig_id")
    one, two = (vertices.select(F.col("orig_id").alias(c), F.col("vid").alias(f"{c}_vid")) for c in ("src", "dst"))
    half = dealt(edges, parts, "src").join(one, "src")
    return vertices, dealt(half, parts, "dst").join(two, "dst").select(F.col("src_vid").alias("src"), F.col("dst_vid").alias("dst"))


def read_edgelist(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """White-space pairs, # comments; Spark opens .gz by its extension."""
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter("value NOT LIKE '#%' AND trim(value) != ''")
    return relabelled(lines.select(fields[0].cast("long").alias("a"), fields[1].cast("long").alias("b")))


def least_arcs(arcs: DataFrame) -> DataFrame:
    """(a, b, w_raw) with a < b: parallel and opposite arcs fall to the least weight, loops go."""
    return arcs.filter("u != v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("w").alias("w_raw"))


def read_dimacs(spark: SparkSession, gr: str, co: str) -> tuple[DataFrame, DataFrame]:
    """(vertices vid, x, y; arcs a, b, w_raw) of DIMACS files; ids from 0, coordinates in millionths. Vertices up to the greatest id exist even without coordinates."""
    fields = F.split(F.trim("value"), r"\s+")
    arcs = spark.read.text(gr).filter("value LIKE 'a %'").select((fields[1].cast("long") - 1).alias("u"), (fields[2].cast("long") - 1).alias("v"), fields[3].cast("double").alias("w"))
    coords = spark.read.text(co).filter("value LIKE 'v %'").select((fields[1].cast("long") - 1).alias("vid"), (fields[2].cast("double") / 1e6).alias("x"), (fields[3].cast("double") / 1e6).alias("y"))
    top = coords.agg(F.max("vid")).first()[0]
    vertices = spark.range(0 if top is None else top + 1).select(F.col("id").alias("vid")).join(coords, "vid", "left")
    return vertices, least_arcs(arcs)


def read_ways(spark: SparkSession, ways: str, nodes: str, ring: Column | None = None, extra: dict[str, list[str]] | None = None, area: tuple[DataFrame, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices vid, x, y; arcs) of an extract as Parquet: ways (id, nodes: array of ids, tags: map) and nodes (id, x, y).

    Ways pass the drive filter or, with ``extra`` (highway, service, tracktype), are extra
    roads (is_extra); of these, ways with a node inside the ring or on it stay whole, or, with
    ``area`` (polygons, most, tile size), ways with a node at most so far from any of the polygons. Arcs join
    consecutive nodes that are known, both ways unless oneway says otherwise (-1: against the
    order), with the tags that lanes and capacities need. Loops go. An extract without such
    ways is an error.
    """
    tags = {c: F.try_element_at("tags", F.lit(c)) for c in (*NOT_DRIVEN, "tracktype")}
    driven = drivable(tags)
    more = F.lit(False) if extra is None else extra_road(tags, extra["highway"], extra["service"], extra["tracktype"])
    kept = spark.read.parquet(ways).withColumns({"driven": driven, "more": more}).filter("driven OR more")
    steps = kept.select("id", F.posexplode("nodes").alias("k", "node"))
    places = spark.read.parquet(nodes).select(F.col("id").alias("node"), "x", "y")
    placed = written(steps.join(places, "node"), "ways-placed")
    inside = placed.filter(covers(ring, F.col("x"), F.col("y"))) if area is None else near_polygons(placed.select("id", "x", "y"), area[0].select(rings_of(area[0]).alias("rings")), area[1], area[2])
    inside = inside.select("id").distinct()
    placed = placed.join(inside, "id", "left_semi")
    nxt = placed.select("id", (F.col("k") - 1).alias("k"), F.col("node").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    names = ["highway", "lanes", "name", "ref", "oneway"]
    about = kept.select("id", (~F.col("driven")).alias("is_extra"), *[F.try_element_at("tags", F.lit(c)).alias(c) for c in names])
    one = placed.join(nxt, ["id", "k"]).join(about, "id").filter("node != dst")
    line = one.select(F.col("id").alias("way"), F.col("node").alias("src"), "dst", F.col("highway").alias("road_class"), "lanes", "name", "ref", F.coalesce(F.col("oneway").isin("yes", "true", "1", "-1"), F.lit(False)).alias("oneway"), "is_extra", F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")).alias("length_m"), F.coalesce(F.col("oneway") == "-1", F.lit(False)).alias("against"))
    flip = line.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    arcs = written(line.filter("NOT against").unionByName(flip.filter("against OR NOT oneway")).drop("against"), "ways-arcs")
    if arcs.isEmpty():
        raise ValueError(f"no road inside the {'ring' if area is None else 'area'} in {ways!r}")
    return placed.select(F.col("node").alias("vid"), "x", "y").distinct(), arcs


def ways_without_places(spark: SparkSession, ways: str, nodes: str) -> DataFrame:
    """(id): ways of an extract that name a node which has no place in it."""
    steps = spark.read.parquet(ways).select("id", F.explode("nodes").alias("node"))
    return steps.join(spark.read.parquet(nodes).select(F.col("id").alias("node")), "node", "left_anti").select("id").distinct()


def read_polygons(spark: SparkSession, path: str, field: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(level, and ring or rings) of a Parquet polygon table; with x0, y0, x1, y1 columns, as :func:`write_sorted` adds them, the box is a pushed-down filter."""
    rows = in_box(spark.read.parquet(path), box)
    return rows.select(F.col(field).cast("int").alias("level"), "rings" if "rings" in rows.columns else "ring")


def in_box(rows: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Rows whose box (x0, y0, x1, y1) touches the given one; all if there is none. Parquet skips row groups by it."""
    if box is None:
        return rows
    return rows.filter((F.col("x0") <= box[2]) & (F.col("x1") >= box[0]) & (F.col("y0") <= box[3]) & (F.col("y1") >= box[1]))


def load_hazard(spark: SparkSession, path: str, kind: str, field: str = "level", bins: list[float] | None = None) -> DataFrame:
    """Hazard layer by kind: polygon (level, ring), or raster (row, col, value, level), the level being the number of ``bins`` that the value reaches."""
    if kind == "polygon":
        return read_polygons(spark, path, field)
    if kind == "raster" and bins:
        level = sum((F.when(F.col("value") >= b, 1).otherwise(0) for b in bins), F.lit(0))
        return spark.read.parquet(path).select("row", "col", "value", level.cast("int").alias("level"))
    raise ValueError(f"unknown hazard kind {kind!r}, or a raster without bins")


def load_roads(spark: SparkSession, source: str, **paths) -> tuple[DataFrame, DataFrame]:
    """Reader by name: edgelist (path), dimacs (gr, co), ways (ways, nodes, ring, extra), parquet (vertices, arcs)."""
    if source == "edgelist":
        return read_edgelist(spark, paths["path"])
    if source == "dimacs":
        return read_dimacs(spark, paths["gr"], paths["co"])
    if source == "ways":
        return read_ways(spark, **paths)
    if source == "parquet":
        return spark.read.parquet(paths["vertices"]), spark.read.parquet(paths["arcs"])
    raise ValueError(f"unknown road source {source!r}")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cached CSV table as text columns, as the vehicle tables come; counts are cast where they are used."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for result tables of bounded size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Rows of a summary as JSON lines in one file; :func:`read_summary` reads them."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Each layer as Parquet under its name, rings and loads included."""
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_sorted(polygons: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """A layer of polygons (ring or rings, ...) as Parquet in the order of a space-filling curve, with the box of each (x0, y0, x1, y1).

    Partitions are ranges of the curve, sorted, in row groups of about ``group_bytes``: polygons that lie close
    together share a group, so a reader's box (:func:`read_polygons`) leaves out most groups by
    their least and greatest boxes. Polygons without points come first, their box null.
    Columns of those names are replaced.
    """
    corners = F.flatten(rings_of(polygons))
    boxes = polygons.withColumns({k: c.cast("double") for k, c in bounds(corners).items()})
    middle = {"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2}
    told = boxes.agg(*[f(c).alias(n) for c, d in zip(middle.values(), "xy", strict=True) for f, n in ((F.min, f"{d}0"), (F.max, f"{d}1"))]).first()
    wide = max((told["x1"] or 0) - (told["x0"] or 0), (told["y1"] or 0) - (told["y0"] or 0)) or 1.0
    place = curve_place(middle["x"], middle["y"], told["x0"] or 0.0, told["y0"] or 0.0, wide)
    rows = boxes.select(F.struct(*[F.col(f"`{c}`") for c in boxes.columns]).alias("row"), place.alias("place"))
    rows = rows.repartitionByRange(shuffle_parts(polygons.sparkSession), "place").sortWithinPartitions("place").select("row.*")
    rows.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def read_config(path: str) -> dict:
    """Settings of a study from YAML."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("settings are read with PyYAML, which is not installed") from e
    with open(path) as f:
        return yaml.safe_load(f)


def class_table(spark: SparkSession, capacity: dict) -> tuple[DataFrame, tuple[float, float]]:
    """Lanes and capacity per lane by road class from settings {class: [per_lane, lanes], ..., default: [...]}, as :func:`egress.functions.roads.with_capacity` takes them."""
    rows = [(k, float(lanes), float(per)) for k, (per, lanes) in capacity.items() if k != "default"]
    per, lanes = capacity["default"]
    return spark.createDataFrame(rows, "road_class string, class_lanes double, per_lane double"), (float(lanes), float(per))
