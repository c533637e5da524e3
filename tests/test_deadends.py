"""Networks with dead ends: results are as without taking them off."""

import random

from pyspark.sql import functions as F

from egress.operators import deadends, evacuation, flow


def stubbed(spark):
    """A ring of streets with trees of dead ends; targets on the ring, one dead end hangs on a target."""
    draw = random.Random(5)
    arcs, eid = [], 0
    for u in ("a", "b"):
        pairs = [(k, (k + 1) % 6) for k in range(6)] + [(k, draw.randrange(6 if k < 20 else k)) for k in range(6, 60)]
        for s, d in pairs:
            for src, dst in ((s, d), (d, s)):
                arcs.append((u, eid, src, dst, float(draw.randint(1, 9)), draw.uniform(1, 9), draw.randrange(4)))
                eid += 1
    table = spark.createDataFrame(arcs, "unit string, eid long, src long, dst long, capacity_vph double, travel_s double, hazard_max int")
    members = spark.createDataFrame([(u, v) for u in ("a", "b") for v in range(6, 60)], "unit string, vid long")
    targets = spark.createDataFrame([("a", 0), ("b", 2), ("b", 4)], "unit string, vid long")
    return table, members, targets


def told(spark):
    arcs, members, targets = stubbed(spark)
    access = flow.accessibility(arcs, members, targets, 2)
    weights = members.withColumn("w", 1.0 + F.col("vid") % 3)
    bound, binding = flow.managed(arcs, weights, targets)
    total = weights.groupBy("unit").agg(F.sum("w").alias("t"))
    shares = weights.join(total, "unit").select("unit", "vid", (F.col("w") / F.col("t")).alias("w"))
    roads = arcs.select("unit", "eid", "src", "dst", F.col("capacity_vph").alias("cap"), F.col("travel_s").alias("t0"))
    routed = evacuation.selfish(roads, shares, targets, bound.withColumn("managed_vph", F.col("managed_vph") * 4))
    rows = [sorted(map(tuple, df.collect())) for df in (access, bound, binding.select("unit", "eid"), routed)]
    return [[tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in t] for t in rows]


def test_results_are_as_without(spark, monkeypatch):
    whole = told(spark)
    monkeypatch.setattr(deadends, "SMALL", 6)
    arcs, _, targets = stubbed(spark)
    off = deadends.peeled(arcs.withColumnRenamed("capacity_vph", "cap"), targets)
    assert off.levels and off.core.count() == 24
    for got, want in zip(told(spark), whole, strict=True):
        assert got == want
