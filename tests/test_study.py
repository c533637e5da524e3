"""Study areas on small layers of our own, geometry against plain Python."""

import itertools
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from egress.functions import geo
from egress.operators import evacuation, hazard, removal, spatial, study
from egress.sources import roads as sources

RINGS = "rings array<array<struct<x:double,y:double>>>"


def layer(spark, rows, columns):
    """Polygons from plain rings, the last value of each row."""
    return spark.createDataFrame([(*r[:-1], [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in r[-1]]) for r in rows], f"{columns}, {RINGS}")


def box(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]


def ring_sides(rings):
    return [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]


def inside(rings, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in ring_sides(rings)) % 2 == 1


def to_side(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])


def apart(one, two):
    """Least distance of two polygons, 0 where they meet."""
    if any(inside(two, *p) for r in one for p in r) or any(inside(one, *p) for r in two for p in r):
        return 0.0
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    best = math.inf
    for (a, b), (c, d) in itertools.product(ring_sides(one), ring_sides(two)):
        if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
            return 0.0
        best = min(best, to_side(a, c, d), to_side(b, c, d), to_side(c, a, b), to_side(d, a, b))
    return best


def blob(rnd, x, y, reach, n):
    """A ring whose corners go round a middle; seldom convex."""
    return [(x + rnd.uniform(0.3, 1) * reach * math.cos(2 * math.pi * k / n), y + rnd.uniform(0.3, 1) * reach * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.mark.parametrize(("size", "most"), [(0.9, 0.0), (4.0, 0.0), (60.0, 0.0), (1.5, 1.1), (30.0, 2.3)])
def test_polygons_that_meet(spark, size, most):
    rnd = random.Random(4)
    frame = [box(-3, -3, 13, 13)[0], box(-2, -2, 12, 12)[0]]
    ones = [[blob(rnd, rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0.3, 2), 7)] for _ in range(14)] + [frame, box(-30, 0, -25, 1)]
    twos = [[blob(rnd, rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0.3, 1.2), 5)] for _ in range(14)] + [[blob(rnd, 1, 1, 0.5, 5), blob(rnd, 9, 9, 0.5, 5)], box(12.2, 4, 12.5, 5)]
    met = spatial.meeting(layer(spark, list(enumerate(ones)), "a int"), layer(spark, list(enumerate(twos)), "b int"), size, most)
    rows = met.collect()
    got = {(r.one.a, r.two.b) for r in rows}
    assert got == {(i, j) for (i, a), (j, b) in itertools.product(enumerate(ones), enumerate(twos)) if apart(a, b) <= most}
    assert len(rows) == len(got)


def test_clusters_and_groups(spark):
    """Borders that touch count, without a share; parts of one label are one area; an area that two fires met comes twice."""
    parts = layer(spark, [("a", 2, "Unincorporated - Upper Ash", "u", box(0, 0, 2, 2)), ("a", 1, "City of Ash", "c", box(6, 0, 8, 2)), ("b", 3, "Los Angeles - Birch", "c", box(2, 4, 4, 6)), ("far", 4, "Elm", "c", box(90, 90, 91, 91))], "area string, part int, label string, kind string")
    areas = study.dissolved(parts, ["area"], "part").drop("part")
    assert {r.area: (r.label, len(r.rings)) for r in areas.collect()} == {"a": ("City of Ash", 2), "b": ("Los Angeles - Birch", 1), "far": ("Elm", 1)}
    fires = layer(spark, [("one", box(1, -1, 3, 3)), ("two", box(3, 4, 9, 9)), ("two", box(7, -5, 9, 0))], "fire string")
    found = study.communities("areas", areas, 1.7, fires=study.dissolved(fires.withColumn("k", F.monotonically_increasing_id()), ["fire"], "k").drop("k"))
    assert {(r.cid, r.cluster): (r.name, round(r.burn_share, 9)) for r in found.collect()} == {("a", "one"): ("Ash", 0.25), ("a", "two"): ("Ash", 0.0), ("b", "two"): ("Birch", 0.5)}
    blocks = spark.createDataFrame([(1, 0.5, 0.5, 10, 4), (2, 6.5, 1.0, 5, 1), (3, 3.5, 5.5, 0, 2), (4, 50.0, 50.0, 7, 7), (5, 2.0, 1.0, 3, 3)], "block long, x double, y double, pop long, housing long")
    places, told = study.populated(found, blocks, 1.7)
    assert {(r.cid, r.cluster): (r.pop, r.housing) for r in places.collect()} == {("a", "one"): (15, 5), ("a", "two"): (15, 5), ("b", "two"): (0, 2)}
    assert tuple(told.first()) == (25, 10)
    assert [(r.cluster, r.cid) for r in study.burned_groups(places, 0.1).collect()] == [("one", "a")]
    with pytest.raises(ValueError, match="kind"):
        study.communities("towns", areas, 1.7)


def test_places_zones_and_perimeters(spark):
    county = layer(spark, [(0, [[(0, 0), (10, 0), (0, 10)]])], "k int")
    plots = layer(spark, [(1, "A", "A city", "C1", box(1, 1, 2, 2)), (2, "B", "B CDP", "U1", box(9, 9, 11, 11)), (3, "C", "C CDP", "U2", box(5, 5, 6, 6)), (4, "D", "D", "C5", [])], "id int, name string, label string, class string")
    assert {(r.cid, r.kind) for r in study.communities("places", plots, 2.0, county=county).collect()} == {(1, "incorporated"), (3, "CDP")}
    state, local = layer(spark, [(1, 3, box(0, 0, 1, 1)), (2, 0, box(0, 0, 1, 1)), (3, 1, box(30, 0, 31, 1))], "id int, level int"), layer(spark, [(1, -3, box(0, 0, 1, 1)), (2, 2, box(13, 0, 14, 1))], "id int, level int")
    zones = study.hazard_zones({"state": state, "local": local}, county, 2.0, 3.5)
    assert {(r.id.zone, r.source_map, r.level) for r in zones.collect()} == {(1, "state", 3), (2, "local", 2)}
    past = layer(spark, [("ELK", 2019, "N", box(0, 0, 1, 1)), ("ELK", 2020, "N", box(0, 0, 1, 1)), ("ELK", 2019, "S", box(0, 0, 1, 1)), (None, 2019, "N", box(0, 0, 1, 1))], "fire_name string, year int, unit_id string")
    assert study.fire_perimeter(past, "ELK", 2019, "N").count() == 1


def test_units_and_new_columns(spark):
    places = layer(spark, [(1, "Ash", 10, box(0, 0, 1, 1)), (2, "Birch", 0, box(1, 0, 2, 1)), (3, "Elm National Forest", 4, box(5, 5, 6, 6))], "cid int, name string, pop int")
    groups = spark.createDataFrame([("ELK", "Ash"), ("ELK", "Birch"), ("OWL", "Ash"), ("OWL", "Nowhere")], "fire string, name string")
    fires = spark.createDataFrame([("ELK", 120.0, True), ("OWL", 5.0, False)], "fire string, vehicles double, even_weights boolean")
    listed = study.units(places, groups, fires, "National Forest")
    assert {r.unit: (r.kind, r["pop"], r.vehicles, r.even_weights, r.cids) for r in listed.collect()} == {"Ash": ("community", 10, None, False, [1]), "ELK group": ("fire_group", None, 120.0, True, [1, 2])}
    assert {r.unit: len(r.rings) for r in study.unit_rings(listed, places).collect()} == {"Ash": 1, "ELK group": 2}
    old = spark.createDataFrame([("Ash", 1, 2, 3), ("Elm", 4, 5, 6)], "unit string, I4_a int, I4_b int, h int")
    new = study.refreshed(old, spark.createDataFrame([("Ash", 9, 0)], "unit string, I4_a int, h int"), "I4_")
    assert new.columns == ["unit", "h", "I4_a"] and sorted(map(tuple, new.collect())) == [("Ash", 3, 9), ("Elm", 6, None)]


def test_vehicles_before_a_fire(spark):
    codes = [f"B25044_{k:03d}E" for k in range(1, 16)]
    rows = [("Ash town, Some State", "1", "50", *["1"] * 15), ("Birch, Some State", "2", "x", *["1"] * 14, "N/A"), ("Elm", "3", "9", *["1"] * 15)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["name", "place", "population", *codes]))
    got = study.prefire_vehicles(table, spark.createDataFrame([("Ash",), ("Ash",), ("Birch",)], "name string"))
    assert sorted(map(tuple, got.collect())) == [("Ash", "1", 50, 30.0), ("Birch", "2", None, None)]


def test_prepared_layers(spark, tmp_path):
    segments = spark.createDataFrame([(1, 0.0, 0.5, 4.0, 0.5), (2, 0.0, 9.0, 4.0, 9.0), (3, 1.0, 0.5, 3.0, 0.5)], "eid long, x0 double, y0 double, x1 double, y1 double")
    zones = layer(spark, [(2, box(0, 0, 2, 1)), (3, box(3, 0, 9, 1))], "level int")
    county = layer(spark, [(0, box(-5, -5, 20, 20))], "k int")
    path = f"file://{tmp_path}/study"
    assert {(r.hazard_max, r.n) for r in study.prepare(segments, zones, county, county, path, 2.0, [1, 2, 3]).collect()} == {(3, 1), (0, 1), (2, 1)}
    edges = {r.eid: (r.hazard_share_1, r.hazard_share_2, r.hazard_share_3) for r in spark.read.parquet(f"{path}/edges").collect()}
    assert edges == {1: (0.0, 0.5, 0.25), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.5, 0.0)}
    assert [r.level for r in sources.read_polygons(spark, f"{path}/zones", "level", (2.5, 0.0, 4.0, 4.0)).collect()] == [3]


def test_a_box_reads_few_row_groups(spark, tmp_path):
    """Plots in no order of place; after sorting, the box's groups are a few of many, by the footers and by what the scan puts out."""
    k = F.col("id")
    plots = spark.range(0, 40000).select("id", (F.xxhash64(k) % 1000).cast("double").alias("cx"), (F.xxhash64(k + 1) % 1000).cast("double").alias("cy"), F.lit("kept").alias("x0"))
    plots = plots.withColumn("ring", geo.rectangle(F.col("cx"), F.col("cy"), F.col("cx") + 3, F.col("cy") + 3)).unionByName(plots.limit(1).withColumns({"id": F.lit(-1).cast("long"), "ring": F.array().cast("array<struct<x:double,y:double>>")}))
    sources.write_sorted(plots, f"file://{tmp_path}/plots", 64 << 10)
    wanted = (200.0, 200.0, 260.0, 260.0)
    groups = [g for f in tmp_path.glob("plots/*.parquet") for m in [pq.ParquetFile(f)] for g in (m.metadata.row_group(i) for i in range(m.num_row_groups))]

    def may(g):
        told = {g.column(i).path_in_schema: g.column(i).statistics for i in range(g.num_columns)}
        return told["x0"].min <= wanted[2] and told["x1"].max >= wanted[0] and told["y0"].min <= wanted[3] and told["y1"].max >= wanted[1]

    assert len(groups) > 20 and sum(map(may, groups)) <= len(groups) / 4
    read = sources.in_box(spark.read.parquet(f"file://{tmp_path}/plots"), wanted)
    kept = read.filter("x0 <= 260").select("id")
    want = plots.filter("size(ring) > 0 AND cx BETWEEN 197 AND 260 AND cy BETWEEN 197 AND 260").select("id")
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in want.collect())
    scan = kept._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() <= 40001 / 4
    empty = layer(spark, [], "k int")
    sources.write_sorted(empty, f"file://{tmp_path}/none")
    assert sources.in_box(spark.read.parquet(f"file://{tmp_path}/none"), wanted).count() == 0


def test_ways_near_an_area(spark, tmp_path):
    """Ways with a node near any polygon of the core stay whole; ways with unknown nodes are told."""
    spark.createDataFrame([(k, float(k), 0.0) for k in range(9)], "id long, x double, y double").write.parquet(f"file://{tmp_path}/nodes")
    road = {"highway": "residential"}
    spark.createDataFrame([(1, [0, 1], road), (2, [2, 3], road), (3, [6, 7, 8], road), (4, [3, 77], road)], "id long, nodes array<long>, tags map<string,string>").write.parquet(f"file://{tmp_path}/ways")
    paths = (f"file://{tmp_path}/ways", f"file://{tmp_path}/nodes")
    core = layer(spark, [(0, box(0, 2, 0.5, 3)), (1, box(8, -3, 9, -2))], "way int")
    _, arcs = sources.read_ways(spark, *paths, area=(core, 2.05, 5.0))
    assert sorted({tuple(sorted((r.src, r.dst))) for r in arcs.collect()}) == [(0, 1), (6, 7), (7, 8)]
    assert [r.id for r in sources.ways_without_places(spark, *paths).collect()] == [4]
    with pytest.raises(ValueError, match="area"):
        sources.read_ways(spark, *paths, area=(core, 0.5, 5.0))


def test_figure_data(spark):
    curves = spark.createDataFrame([("a", 0, 0.4), ("a", 500, 0.1), ("b", 0, None), ("b", 500, 0.2)], "order_name string, permille int, e double")
    assert sorted((r.order_name, r.permille, round(r.e, 9)) for r in removal.relative(curves, "e").collect()) == [("a", 0, 1.0), ("a", 500, 0.25), ("b", 500, 0.5)]
    values = spark.createDataFrame([(float(k),) for k in range(0, 11)], "v double")
    assert [(round(r.value, 6), round(r.share, 6)) for r in removal.ccdf_points(values, "v", 4).orderBy("value").collect()] == [(round(v / 5.5, 6), round(1 - (v - 1) / 10, 6)) for v in (1, 3, 5, 7, 9)]
    assert removal.ccdf_points(values.filter("v < 0"), "v").count() == 0


def test_ways_that_rest(spark):
    """One wide road: the ways never change. Two narrow ones of equal time: drivers swing from one to the other."""
    arcs = spark.createDataFrame([("wide", 1, 0, 9, 100.0, 5.0), ("two", 2, 0, 1, 10.0, 5.0), ("two", 3, 1, 9, 50.0, 1.0), ("two", 4, 0, 2, 10.0, 5.5), ("two", 5, 2, 9, 50.0, 1.0)], "unit string, eid long, src long, dst long, cap double, t0 double")
    units = arcs.select("unit").distinct()
    start, goals = units.select("unit", F.lit(0).cast("long").alias("vid"), F.lit(1.0).alias("w")), units.select("unit", F.lit(9).cast("long").alias("vid"))
    managed = spark.createDataFrame([("wide", 60.0), ("two", 20.0), ("none", 0.0)], "unit string, managed_vph double")
    got = {r.unit: r for r in evacuation.selfish(arcs, start, goals, managed).collect()}
    assert (got["wide"].strict_vph, got["wide"].strict_converged) == (60.0, True)
    assert got["two"].strict_vph <= 10 and got["two"].strict_converged
    assert (got["none"].strict_vph, got["none"].strict_converged, got["none"].rationed_converged) == (0.0, None, None)
    assert got["two"].rationed_vph >= got["two"].strict_vph and got["two"].rationed_converged is not None


def test_small_polygons_stay_whole_and_files_say_nothing_of_rings(spark, monkeypatch):
    """Few corners: no halving, the same pairs and shares as of polygons that are cut, and no table of rings broadcast because its file is small."""
    rnd = random.Random(8)
    ones = [[blob(rnd, rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0.3, 2), 7)] for _ in range(20)] + [box(-3, -3, 13, 13)]
    twos = [[blob(rnd, rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0.3, 2), n)] for n in (4, 5, 9, 12) * 5]
    one, two = layer(spark, list(enumerate(ones)), "area int"), layer(spark, list(enumerate(twos)), "fire int")
    assert {len(r.piece[0]) for r in spatial.pieces(two, 1.5, 1.0, whole=True).collect()} == {4, 5, 9, 12}
    plan = spatial.meeting(one, two, 1.5)._jdf.queryExecution().executedPlan().toString() + spatial.burn_shares(one, two, 1.5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan

    def told():
        met = {(r.one.area, r.two.fire) for r in spatial.meeting(one, two, 1.5, 0.4).collect()}
        return met, {(r.area, r.fire): round(r.share, 9) for r in spatial.burn_shares(one, two, 1.5).collect()}

    whole = told()
    monkeypatch.setattr(spatial, "WHOLE", 7)
    assert told() == whole


def test_segments_of_one_file_are_dealt(spark):
    """Segments that come in one partition are looked at by more than one task, with the same shares."""
    segments = spark.range(40).coalesce(1).selectExpr("id AS eid", "double(id) - 20 AS x0", "0.5D AS y0", "double(id) AS x1", "0.5D AS y1")
    found = hazard.overlay_polygons(segments, layer(spark, [(1, box(0, 0, 4, 1))], "level int"), 1.0)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.eid: round(r.share, 9) for r in found.collect()} == {k: (min(4, k) - max(0, k - 20)) / 20 for k in range(1, 24)}
