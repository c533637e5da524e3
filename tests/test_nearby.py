"""Networks around their origins tell what the whole network of several regions tells, however narrow they begin."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from egress.operators import evacuation, flow, nearby, regions, routing

WIDE = 14
ARCS = "unit string, eid long, src long, dst long, capacity_vph double, travel_s double, hazard_max int"


def town(spark):
    """Grids with origins in a corner, where streets jam, and targets elsewhere; the last has none that can be reached, in the one before nobody jams."""
    arcs, weights, targets = [], [], []
    for u in range(5):
        rnd = random.Random(u)
        pairs = [(a, b) for v in range(WIDE * WIDE) for x in (v + 1, v + WIDE) if x < WIDE * WIDE and (x != v + 1 or x % WIDE) for a, b in ((v, x), (x, v)) if rnd.random() < 0.95]
        goals = {v for v in range(WIDE * WIDE) if rnd.random() < (0.1, 0.3, 0.05, 0.4, 0.0)[u] and v % WIDE + v // WIDE > 1}
        arcs += [(str(u), k, a, b, float(rnd.randint(2, 9)) if u != 3 else 1e4, float(rnd.randint(1, 50)), rnd.randint(0, 3)) for k, (a, b) in enumerate(pairs)]
        weights += [(str(u), v, 1.0 + v % 3) for v in range(4 * WIDE) if v % WIDE < 4 and v not in goals]
        targets += [(str(u), v) for v in goals]
    where = regions.by_order(spark.range(WIDE * WIDE).withColumnRenamed("id", "vid"), most=50)
    return *(spark.createDataFrame(r, c) for r, c in ((arcs, ARCS), (weights, "unit string, vid long, w double"), (targets, "unit string, vid long"))), where


@pytest.fixture
def jobs(monkeypatch):
    """How often each table was written by the operators."""
    seen, real = Counter(), regions.written

    def counted(df, name, **options):
        seen[name] += 1
        return real(df, name, **options)

    for module in (nearby, regions, routing, flow):
        monkeypatch.setattr(module, "written", counted)
    return seen


@pytest.mark.parametrize("hops", [1, 4])
def test_largest_demand_around_origins(spark, monkeypatch, jobs, hops):
    monkeypatch.setattr(nearby, "HOPS", hops)
    arcs, weights, targets, where = town(spark)
    told = lambda x: ({r.unit: r.managed_vph for r in x[0].collect()}, {(r.unit, r.src, r.dst) for r in x[1].collect()})
    got = told(flow.managed(arcs, weights, targets, regions=where))
    assert not jobs["flow-state"]  # before, each of Newton's steps was some rounds over all regions
    want = told(flow.managed(arcs, weights, targets))
    assert got[0] == pytest.approx(want[0]) and len(got[0]) == 4 and got[1] == want[1]


def test_drivers_around_origins(spark, monkeypatch, jobs):
    """Drivers who get to the edge are settled again in a wider network; the others never see the rest of it."""
    monkeypatch.setattr(nearby, "HOPS", 2)
    arcs, weights, targets, where = town(spark)
    totals = weights.groupBy("unit").agg(F.sum("w").alias("total"))
    shares = weights.join(totals, "unit").select("unit", "vid", (F.col("w") / F.col("total")).alias("w"))
    roads = arcs.select("unit", "eid", "src", "dst", F.col("capacity_vph").alias("cap"), F.col("travel_s").alias("t0"))
    managed = spark.createDataFrame([(str(u), d) for u, d in enumerate((20.0, 30.0, 12.0, 50.0))], "unit string, managed_vph double")
    told = lambda df: {r.unit: tuple(r)[1:] for r in df.collect()}
    got = told(evacuation.selfish(roads, shares, targets, managed, regions=where))
    assert jobs["near-units"] > 1 and jobs["routes-phase"] <= 4 * jobs["near-units"]  # before, some jobs for each of up to 60 rounds
    want = told(evacuation.selfish(roads, shares, targets, managed))
    assert got == {u: pytest.approx(x) for u, x in want.items()} and any(x[1] < x[0] for x in want.values())


def test_what_is_too_large_for_a_task_is_worked_whole(spark, monkeypatch, jobs):
    monkeypatch.setattr(nearby, "MOST", 40)
    monkeypatch.setattr(nearby, "HOPS", 1)
    arcs, weights, targets, where = town(spark)
    got = {r.unit: r.managed_vph for r in flow.managed(arcs, weights, targets, regions=where)[0].collect()}
    assert jobs["flow-state"] and got == pytest.approx({r.unit: r.managed_vph for r in flow.managed(arcs, weights, targets)[0].collect()})


def test_access_around_origins(spark, monkeypatch, jobs):
    """Flows, cuts and times; before, Python held every region of the network."""
    monkeypatch.setattr(nearby, "HOPS", 2)
    arcs, weights, targets, where = town(spark)
    told = lambda **more: {r.unit: tuple(r)[1:] for r in flow.accessibility(arcs, weights, targets, 2, **more).collect()}
    got = told(regions=where)
    assert not jobs["flow-state"] and not jobs["distances"]
    want = told()
    assert {u: x[:4] for u, x in got.items()} == {u: x[:4] for u, x in want.items()} and len(got) == 5
    assert all(got[u][4:] == pytest.approx(want[u][4:]) for u in "0123") and got["4"][5] and want["4"][5]
