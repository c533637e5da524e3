"""Networks around their origins, for units of many regions.

However large a network is, what starts at a unit's origins mostly ends at targets near by. So
the vertices that origins come to within some arcs, not through targets, are worked in one
task. What lies beyond is taken for closed and for a target: both bound what the whole
network says, so where they tell the same it is what the whole network says, exactly. Where
they don't, the network around the origins is taken twice as wide, until nothing lies beyond
or it is too large for a task; such a unit is worked whole, by regions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from egress.operators.regions import REGION
from egress.plans.store import written

#: Arcs from an origin to the edge, at first.
HOPS = 16
#: Vertices of the network around a unit's origins, at most: what one task holds.
MOST = 2 * REGION
#: Steps outwards in one job.
STRIDE = 4


class Around(NamedTuple):
    """``arcs`` of the vertices within, ``targets`` and ``edge`` (unit, vid): their heads that are targets, or lie beyond; ``units``: (unit) of what fits a task; ``regions``: (vid, region), all in one."""

    arcs: DataFrame
    targets: DataFrame
    edge: DataFrame
    units: DataFrame
    regions: DataFrame


class Nearby:
    """Networks around origins (unit, vid), ever wider; each is made once, however often it is iterated over. Arcs (unit, src, dst, ...) that leave targets are left out: nothing goes on from there."""

    def __init__(self, arcs: DataFrame, origins: DataFrame, targets: DataFrame, most: int | None = None):
        self.most = MOST if most is None else most
        self._found, self._more = [], self._widened(arcs, origins, targets)

    def __iter__(self) -> Iterator[Around]:
        k = 0
        while True:
            if k == len(self._found):
                wider = next(self._more, None)
                if wider is None:
                    return
                self._found.append(wider)
            yield self._found[k]
            k += 1

    def _widened(self, arcs: DataFrame, origins: DataFrame, targets: DataFrame) -> Iterator[Around]:
        by = ["unit", "vid"]
        starts = written(origins.select(*by).distinct(), "near-origins")
        small = starts.groupBy("unit").count().filter(F.col("count") <= self.most).select("unit")
        within = written(starts.join(small, "unit", "left_semi"), "near-within")
        if within.isEmpty():
            return
        goals = targets.select(*by).distinct()
        ways = arcs.filter("src != dst").select("unit", F.col("src").alias("vid"), "dst").join(goals, by, "left_anti")
        ways = written(ways.groupBy(*by).agg(F.collect_set("dst").alias("next")), "near-ways")
        done, hops = 0, HOPS
        while True:
            while done < hops:
                for _ in range(min(STRIDE, hops - done)):
                    onward = F.concat(F.array("vid"), F.coalesce("next", F.array().cast("array<bigint>")))
                    within = within.join(ways, by, "left").select("unit", F.explode(onward).alias("vid")).distinct()
                    done += 1
                within = written(within, "near-within")
            inner = written(within.join(ways.select(*by), by, "left_semi"), "near-inner")
            own = written(arcs.join(inner.withColumnRenamed("vid", "src"), ["unit", "src"], "left_semi").select(*arcs.columns), "near-arcs")
            heads = written(own.select("unit", F.col("dst").alias("vid")).union(starts).union(inner).distinct(), "near-vertices")
            units = written(heads.join(inner.select("unit").distinct(), "unit", "left_semi").groupBy("unit").count().filter(F.col("count") <= self.most).select("unit"), "near-units")
            if units.isEmpty():
                return
            fits = lambda df: df.join(units, "unit", "left_semi")  # noqa: E731, B023
            edge = written(fits(heads.join(ways.select(*by), by, "left_semi").join(inner, by, "left_anti")), "near-edge")
            met = written(fits(heads).join(goals, by, "left_semi"), "near-targets")
            regions = written(fits(heads).select("vid").distinct().withColumn("region", F.lit(0).cast("long")), "near-regions")
            yield Around(fits(own).select(*arcs.columns), met, edge, units, regions)
            within, hops = fits(within), 2 * hops
