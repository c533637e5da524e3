"""Road networks derived from the test tables, in SQL that Spark and DuckDB both read. {name} stands for a table."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

from egress.operators.graph import dealt, undirected_unique
from egress.plans.store import shuffle_parts

#: Line items in a part of the graph.
PART_ROWS = 1 << 18

_WIDE = "(SELECT CAST(floor(sqrt(count(*))) AS BIGINT) FROM {customer})"

LATTICE_V = f"""
SELECT c_custkey AS vid, CAST(100 * (c_custkey % {_WIDE}) AS DOUBLE) AS x, CAST(100 AS DOUBLE) * CAST(floor(c_custkey / {_WIDE}) AS BIGINT) AS y,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'motorway' WHEN 'BUILDING' THEN 'trunk' WHEN 'FURNITURE' THEN 'primary'
            WHEN 'HOUSEHOLD' THEN 'residential' ELSE 'tertiary' END AS road_class,
       1 + abs(c_acctbal) AS travel_s, CAST(c_nationkey % 4 AS INT) AS hazard_max
FROM {{customer}}"""

LATTICE_A = f"""
SELECT CAST(4 * s.vid + k AS BIGINT) AS eid, CASE WHEN k % 2 = 0 THEN s.vid ELSE s.other END AS src, CASE WHEN k % 2 = 0 THEN s.other ELSE s.vid END AS dst,
       v.road_class, v.travel_s, v.hazard_max, CAST(100 AS DOUBLE) AS length_m,
       CAST(CASE v.road_class WHEN 'motorway' THEN 4000 WHEN 'trunk' THEN 3000 WHEN 'primary' THEN 1800 WHEN 'tertiary' THEN 900 ELSE 600 END AS DOUBLE) AS capacity_vph
FROM (SELECT a.vid, b.vid AS other, 0 AS k FROM ({LATTICE_V}) a JOIN ({LATTICE_V}) b ON b.vid = a.vid + 1 AND b.y = a.y
      UNION ALL SELECT a.vid, b.vid, 1 FROM ({LATTICE_V}) a JOIN ({LATTICE_V}) b ON b.vid = a.vid + 1 AND b.y = a.y
      UNION ALL SELECT a.vid, b.vid, 2 FROM ({LATTICE_V}) a JOIN ({LATTICE_V}) b ON b.vid = a.vid + {_WIDE}
      UNION ALL SELECT a.vid, b.vid, 3 FROM ({LATTICE_V}) a JOIN ({LATTICE_V}) b ON b.vid = a.vid + {_WIDE}) s
JOIN ({LATTICE_V}) v ON v.vid = CASE WHEN k % 2 = 0 THEN s.vid ELSE s.other END"""

#: Customers feed nations, nations regions, regions one sink, for each market segment; whole capacities, so sums are exact.
FOREST_C = "SELECT c_mktsegment AS unit, c_custkey AS vid, c_nationkey AS nk, n_regionkey AS rk, CAST(5 + c_custkey % 7 AS DOUBLE) AS cap, 1 + abs(c_acctbal) AS travel_s FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"
FOREST_N = f"SELECT unit, nk, rk, CAST(count(*) * (4 + nk % 5) AS DOUBLE) AS cap, count(*) AS n FROM ({FOREST_C}) f GROUP BY unit, nk, rk"
FOREST_R = f"SELECT unit, rk, CAST(count(*) * (5 + rk % 3) AS DOUBLE) AS cap, count(*) AS n FROM ({FOREST_C}) f GROUP BY unit, rk"
FOREST_A = f"""
SELECT unit, vid AS eid, vid AS src, CAST(-1 - nk AS BIGINT) AS dst, cap AS capacity_vph, travel_s, 0 AS hazard_max FROM ({FOREST_C}) c
UNION ALL SELECT unit, CAST(-1 - nk AS BIGINT), CAST(-1 - nk AS BIGINT), CAST(-100 - rk AS BIGINT), cap, CAST(10 AS DOUBLE), CAST(nk % 4 AS INT) FROM ({FOREST_N}) n
UNION ALL SELECT unit, CAST(-100 - rk AS BIGINT), CAST(-100 - rk AS BIGINT), CAST(-1000 AS BIGINT), cap, CAST(20 AS DOUBLE), CAST(rk % 4 AS INT) FROM ({FOREST_R}) r"""

#: The forest with capacities of which no two classes bind at once, and roads by class; a lane is worth three classes.
POLICY_A = f"""
SELECT unit, vid AS eid, vid AS src, CAST(-1 - nk AS BIGINT) AS dst, CAST(5.2 AS DOUBLE) + vid % 7 AS capacity_vph, travel_s, 0 AS hazard_max, CAST(100 AS DOUBLE) AS length_m,
       concat('lane', CAST(vid % 7 AS STRING)) AS road_key, CAST(3 AS DOUBLE) AS per_lane FROM ({FOREST_C}) c
UNION ALL SELECT unit, CAST(-1 - nk AS BIGINT), CAST(-1 - nk AS BIGINT), CAST(-100 - rk AS BIGINT), n * (CAST(4.1 AS DOUBLE) + nk % 5), CAST(10 AS DOUBLE), CAST(nk % 4 AS INT), CAST(200 AS DOUBLE),
       concat('nation', CAST(nk % 5 AS STRING)), CAST(3 * n AS DOUBLE) FROM ({FOREST_N}) n
UNION ALL SELECT unit, CAST(-100 - rk AS BIGINT), CAST(-100 - rk AS BIGINT), CAST(-1000 AS BIGINT), n * (CAST(5.3 AS DOUBLE) + rk % 3), CAST(20 AS DOUBLE), CAST(rk % 4 AS INT), CAST(300 AS DOUBLE),
       concat('region', CAST(rk % 3 AS STRING)), CAST(3 * n AS DOUBLE) FROM ({FOREST_R}) r"""

PAIRS = "SELECT l_orderkey AS a, -1 - l_partkey AS b FROM {lineitem}"
EDGES = f"SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM ({PAIRS}) p WHERE a != b"
NODES = f"SELECT src AS vid FROM ({EDGES}) e UNION SELECT dst FROM ({EDGES}) e"

TABLES = ("customer", "nation", "region", "supplier", "part", "orders", "lineitem", "embeddings")


class Tables:
    """The test tables of one folder as DataFrames, and SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self[t] for t in TABLES if "{" + t + "}" in text})

    def edges(self) -> DataFrame:
        """EDGES, in as many parts as its rows ask for, so that what a task holds doesn't grow with the input."""
        return undirected_unique(self.sql(PAIRS), self.parts())

    def nodes(self) -> DataFrame:
        """NODES, in as many parts as well."""
        return dealt(self.sql(f"SELECT explode(array(a, b)) AS vid FROM ({PAIRS}) p WHERE a != b"), self.parts(), "vid").distinct()

    def parts(self) -> int:
        """Parts of the graph of all line items."""
        return max(shuffle_parts(self.spark), ceil(self["lineitem"].count() / PART_ROWS))


def duck(text: str) -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
