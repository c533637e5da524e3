"""Readers and sinks on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from egress.functions import geo, roads
from egress.operators import removal
from egress.sources import roads as sources


def test_gzip_by_extension(spark, tmp_path):
    with gzip.open(tmp_path / "e.txt.gz", "wt") as f:
        f.write("# links\n3 8\n8 3\n8 11\n")
    assert sorted(map(tuple, sources.read_edgelist(spark, f"file://{tmp_path}/e.txt.gz")[1].collect())) == [(0, 1), (1, 2)]


def test_ways_and_nodes(spark, tmp_path):
    nodes = [(k, float(k), 0.0) for k in range(6)] + [(9, 50.0, 50.0), (10, 51.0, 50.0)]
    ways = [
        (1, [0, 1, 2], {"highway": "residential", "lanes": "2"}),
        (2, [2, 3], {"highway": "primary", "oneway": "yes", "name": "High Street"}),
        (3, [3, 4], {"highway": "primary", "oneway": "-1"}),
        (4, [4, 5], {"highway": "track"}),
        (5, [9, 10], {"highway": "residential"}),
        (6, [0, 5], {"highway": "footway"}),
        (7, [1, 99], {"highway": "residential"}),
        (8, [2, 2], {"highway": "residential"}),
        (9, [4, 5], {"name": "no highway"}),
    ]
    spark.createDataFrame(nodes, "id long, x double, y double").write.parquet(f"file://{tmp_path}/nodes")
    spark.createDataFrame(ways, "id long, nodes array<long>, tags map<string,string>").write.parquet(f"file://{tmp_path}/ways")
    ring = geo.ring((0, -1), (4, -1), (4, 1), (0, 1))
    paths = {"ways": f"file://{tmp_path}/ways", "nodes": f"file://{tmp_path}/nodes", "ring": ring}
    vertices, arcs = sources.load_roads(spark, "ways", **paths)
    assert sorted((r.src, r.dst) for r in arcs.collect()) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (4, 3)]
    assert arcs.filter("is_extra").isEmpty() and {r.vid for r in vertices.collect()} == {0, 1, 2, 3, 4}
    assert arcs.filter("src = 2 AND dst = 3").select("name", "oneway", "length_m").first() == ("High Street", True, 1.0)
    _, more = sources.load_roads(spark, "ways", **paths, extra={"highway": ["track"], "service": [], "tracktype": ["grade5"]})
    assert sorted((r.src, r.dst) for r in more.filter("is_extra").collect()) == [(4, 5), (5, 4)]
    with pytest.raises(ValueError, match="no road"):
        sources.read_ways(spark, paths["ways"], paths["nodes"], geo.ring((90, 90), (91, 90), (91, 91)))


def test_hazard_layers(spark, tmp_path):
    zone = spark.range(2).select(F.col("id").alias("zone"), F.lit("x").alias("other"), (F.col("id") * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 10.0 + 1).alias("x1"), F.lit(1.0).alias("y1"), geo.ring((0, 0), (1, 0), (1, 1)).alias("ring"))
    zone.write.parquet(f"file://{tmp_path}/zones")
    assert [r.level for r in sources.load_hazard(spark, f"file://{tmp_path}/zones", "polygon", "zone").orderBy("level").collect()] == [0, 1]
    assert [r.level for r in sources.read_polygons(spark, f"file://{tmp_path}/zones", "zone", (9.0, 0.0, 12.0, 1.0)).collect()] == [1]
    spark.createDataFrame([(0, 0, 5.0), (0, 1, -1.0), (1, 0, None)], "row long, col long, value double").write.parquet(f"file://{tmp_path}/pixels")
    assert sorted(r.level for r in sources.load_hazard(spark, f"file://{tmp_path}/pixels", "raster", bins=[0.0, 4.0]).collect()) == [0, 0, 2]
    with pytest.raises(ValueError, match="kind"):
        sources.load_hazard(spark, "x", "raster")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "k long, t string")
    path = f"file://{tmp_path}"
    sources.write_csv(rows, f"{path}/csv")
    assert sorted((r.k, r.t) for r in sources.read_cache(spark, f"{path}/csv").collect()) == [("1", 'a "b", c'), ("2", None)]
    sources.write_summary(rows, f"{path}/json")
    assert sorted((r.k, r.t) for r in sources.read_summary(spark, f"{path}/json").collect()) == [(1, 'a "b", c'), (2, None)]
    sources.write_layers({"v": rows, "a": rows.limit(1)}, f"{path}/layers")
    vertices, arcs = sources.load_roads(spark, "parquet", vertices=f"{path}/layers/v", arcs=f"{path}/layers/a")
    assert (vertices.count(), arcs.count()) == (2, 1)


def test_vehicle_table(spark):
    """All twelve counts of owners and renters; a count that isn't a number leaves the group without an estimate."""
    codes = sorted(roads.VEHICLE_CODES)
    rows = [["1"] * 12, ["0"] * 11 + ["2"], ["N/A"] + ["1"] * 11]
    table = spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in codes))
    counts = {k: F.expr(f"try_cast(c{k} AS double)") for k in codes}
    assert [r[0] for r in table.select(roads.vehicles(counts)).collect()] == [30.0, 10.0, None]


def test_before_and_after(spark):
    arcs = spark.createDataFrame([(1, 5), (2, 7)], "eid long, cap long")
    out = removal.before_and_after(arcs, F.col("eid") == 1, lambda df: df.agg(F.sum("cap").alias("cap")))
    assert {r.state: r.cap for r in out.collect()} == {"before": 12, "after": 7}
