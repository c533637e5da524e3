"""Chains of a directed street network as single arcs."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from egress.plans.store import released, written


def between(arcs: DataFrame) -> DataFrame:
    """(vid): vertices that only join two others: one way through, or both ways. A vertex with a loop, a fork or a dead end is none."""
    ends = arcs.select(F.col("src").alias("vid"), F.col("dst").alias("other"), F.lit(1).alias("out")).union(arcs.select("dst", "src", F.lit(0)))
    by = ends.groupBy("vid").agg(F.count_distinct("other").alias("others"), F.sum("out").alias("outs"), F.sum(1 - F.col("out")).alias("ins"), F.max(F.col("other") == F.col("vid")).alias("loop"))
    return by.filter("others = 2 AND NOT loop AND outs = ins AND outs IN (1, 2)").select("vid")


def simplified(arcs: DataFrame) -> DataFrame:
    """(eid, src, dst, length_m, travel_s, n, eids): arcs (eid, src, dst, length_m, travel_s), those that run through vertices between two others joined to one.

    A joined arc has the id of its first, sums of length and time, the number of arcs and their ids in
    order, to which tags and shapes can be joined. Each arc finds the first of its chain by
    pointer doubling, so a chain of n arcs takes log n rounds; then chains are summed in one
    grouping. Both directions are joined, each by itself. A ring without any other vertex has no first arc; its arcs stay as they are.
    """
    middle = written(between(arcs), "chain-middle")
    one = arcs.select("eid", "src", "dst").join(middle.withColumnRenamed("vid", "dst"), "dst", "left_semi")
    follow = one.select(F.col("eid").alias("prev"), F.col("src").alias("back"), F.col("dst").alias("src"))
    steps = arcs.select("eid", "src", "dst").join(follow, "src").filter("dst != back").select("eid", "prev")
    places = arcs.select("eid").join(steps, "eid", "left").select("eid", F.coalesce("prev", "eid").alias("at"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("k"), F.col("prev").isNull().alias("first"))
    seen = Observation()
    places = written(places.observe(seen, F.count("*").alias("n"), F.count_if(~F.col("first")).alias("open")), "chain-places")
    n, left = seen.get["n"], seen.get["open"]
    for _ in range(ceil(log2(max(n, 2))) + 1):
        if not left:
            break
        to = places.select(F.col("eid").alias("at"), F.col("at").alias("further"), F.col("k").alias("more"), F.col("first").alias("begun"))
        moved = places.filter("NOT first").join(to, "at").select("eid", F.col("further").alias("at"), (F.col("k") + F.col("more")).alias("k"), F.col("begun").alias("first"))
        seen, last = Observation(), places
        places = written(places.filter("first").unionByName(moved).observe(seen, F.count_if(~F.col("first")).alias("open")), "chain-places")
        left = seen.get["open"]
        released(last)
    head = F.when(F.col("first"), F.col("at")).otherwise(F.col("eid"))  # a ring never comes to a first arc
    rows = arcs.join(places.select("eid", head.alias("head"), F.when(F.col("first"), F.col("k")).otherwise(0).alias("k")), "eid")
    by = rows.groupBy("head").agg(
        F.min_by("src", "k").alias("src"), F.max_by("dst", "k").alias("dst"), F.sum("length_m").alias("length_m"), F.sum("travel_s").alias("travel_s"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("k", "eid"))).alias("order")
    )
    return by.select(F.col("head").alias("eid"), "src", "dst", "length_m", "travel_s", "n", F.transform("order", lambda x: x["eid"]).alias("eids"))
