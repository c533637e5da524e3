"""Dead ends: vertices of a single neighbour, taken off a network before flows, ways and loads are worked out, and put back after.

What starts in a dead end can leave by its one neighbour only, and nothing passes through it,
so its arc's capacity and cost are all that the rest of the network must know. Rounds of one
aggregate take off the outermost vertices until every unit is small enough for one task (streets
lose their stubs); results are as without. Targets are never taken off.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from egress.operators.regions import REGION
from egress.plans.store import released, written

#: Vertices of a unit that one task works through as they are, dead ends included.
SMALL = REGION
#: A round that would take off less than one vertex in so many is not worth its joins; the rest of the network stays as it is.
WORTH = 16


class Peeled(NamedTuple):
    """``levels``: outermost first, (unit, vid, up, cap, cost, outs) of what was taken off, with the neighbour, the capacity, number and least cost of the arcs there. ``core``: the arcs left (unit, eid, src, dst, cap, cost)."""

    levels: list[DataFrame]
    core: DataFrame


def peeled(arcs: DataFrame, targets: DataFrame, single: bool = False) -> Peeled:
    """Takes dead ends off arcs (unit, src, dst, and eid, cap, cost where they are known). ``single``: only those with one arc out, of a positive capacity, as drivers need who choose between parallel arcs."""
    known = lambda c, kind: (F.col(c) if c in arcs.columns else F.lit(None)).cast(kind).alias(c)
    core = arcs.filter("src != dst").select("unit", known("eid", "long"), "src", "dst", known("cap", "double"), known("cost", "double"))
    forth = core.select("unit", "eid", F.col("src").alias("vid"), F.col("dst").alias("other"), "cap", "cost", F.lit(1).alias("outs"))
    back = core.select("unit", "eid", F.col("dst").alias("vid"), F.col("src").alias("other"), F.lit(0.0).alias("cap"), F.lit(None).cast("double").alias("cost"), F.lit(0).alias("outs"))
    ends, goals, levels, last = forth.union(back), targets.select("unit", "vid").distinct(), [], None
    while True:
        around = ends.groupBy("unit", "vid").agg(F.min("other").alias("up"), F.max("other").alias("other"), F.sum("cap").alias("cap"), F.min("cost").alias("cost"), F.sum("outs").alias("outs"))
        around = written(around, "dead-ends-around")
        sizes = around.groupBy("unit").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
        if (sizes["most"] or 0) <= SMALL:
            released(around)
            break
        ending = around.filter("up = other").drop("other").join(goals, ["unit", "vid"], "left_anti")
        if single:
            ending = ending.filter("outs = 1 AND cap >= 1e-9")
        found = Observation()
        ending = written(ending.observe(found, F.count("*").alias("n")), "dead-ends")
        released(around)
        if found.get["n"] * WORTH < sizes["n"]:
            released(ending)
            break
        # Of two that hang on each other alone the smaller stays.
        lower = ending.filter("vid < up")
        each_other = ending.select("unit", F.col("vid").alias("up")).join(lower.select("unit", "up").distinct(), ["unit", "up"], "left_semi")
        leaf = ending.filter("vid > up").unionByName(lower.join(each_other, ["unit", "up"], "left_anti").select(ending.columns))
        levels.append(leaf)
        gone = leaf.select("unit", "vid").hint("merge")
        ends = written(ends.join(gone, ["unit", "vid"], "left_anti").join(gone.withColumnRenamed("vid", "other"), ["unit", "other"], "left_anti").select("unit", "eid", "vid", "other", "cap", "cost", "outs"), "dead-ends-left")
        if last is not None:
            released(last)
        last = ends
    if levels:
        core = ends.filter("outs = 1").select("unit", "eid", F.col("vid").alias("src"), F.col("other").alias("dst"), "cap", "cost")
    return Peeled(levels, core)


def carried(levels: list[DataFrame], amounts: DataFrame, limited: bool, cap: str = "cap") -> tuple[DataFrame, list[DataFrame]]:
    """Amounts (unit, vid, amount) moved out of the dead ends: (what lies on the vertices left, for each level (unit, vid, up, cap, amount, sent)). ``limited``: at most a dead end's capacity leaves it. ``cap``: the column that holds it."""
    rest, told = amounts.select("unit", "vid", F.col("amount").cast("double").alias("amount")), []
    for level in levels:
        here = rest.groupBy("unit", "vid").agg(F.sum("amount").alias("amount"))
        joined = here.join(level.select("unit", "vid", "up", F.col(cap).cast("double").alias("cap")), ["unit", "vid"], "full").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
        found = written(joined.withColumn("sent", F.least("amount", "cap") if limited else F.col("amount")), "dead-ends-carried")
        told.append(found.filter("up IS NOT NULL"))
        on = told[-1].filter("sent > 0").groupBy("unit", F.col("up").alias("vid")).agg(F.sum("sent").alias("amount"))
        rest = found.filter("up IS NULL").select("unit", "vid", "amount").unionByName(on)
    return rest, told


def reaching(told: list[DataFrame], reach: DataFrame) -> DataFrame:
    """(unit, vid) that still reach a target: ``reach`` of the vertices left, and the dead ends with capacity to spare that hang on one that does."""
    for level in reversed(told):
        spare = level.filter("cap > sent").join(reach.withColumnRenamed("vid", "up"), ["unit", "up"], "left_semi")
        reach = written(reach.unionByName(spare.select("unit", "vid")), "dead-ends-reach")
    return reach


def reached(levels: list[DataFrame], dist: DataFrame) -> DataFrame:
    """(unit, vid, dist): ``dist`` of the vertices left, and of the dead ends through their neighbours."""
    for level in reversed(levels):
        through = level.filter("cost IS NOT NULL").join(dist.withColumnsRenamed({"vid": "up", "dist": "on"}), ["unit", "up"])
        dist = written(dist.unionByName(through.select("unit", "vid", (F.col("on") + F.col("cost")).alias("dist"))), "dead-ends-times")
    return dist


def binding(told: list[DataFrame], demand: DataFrame) -> DataFrame:
    """(unit, src, dst): dead ends whose capacity the demand (unit, d) fills, dealt by the amounts as shares; of those behind one another the last."""
    shut, out = None, None
    for level in reversed(told):
        rows = level.join(demand, "unit").withColumn("full", (F.col("amount") > 0) & (F.col("cap") <= F.col("amount") * F.col("d") * (1 + 1e-9)))
        if shut is None:
            rows = rows.withColumn("behind", F.lit(False))
        else:
            rows = rows.join(shut.withColumnsRenamed({"vid": "up"}).withColumn("behind", F.lit(True)), ["unit", "up"], "left").na.fill(False, ["behind"])
        rows = written(rows.filter("full OR behind").select("unit", "vid", "up", "behind"), "dead-ends-full")
        own = rows.filter("NOT behind").select("unit", F.col("vid").alias("src"), F.col("up").alias("dst"))
        out = own if out is None else out.unionByName(own)
        own_shut = rows.select("unit", "vid")
        shut = own_shut if shut is None else shut.unionByName(own_shut)
    return out


def hung(levels: list[DataFrame], weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((unit, vid, w) of the vertices left, with what hangs on them; (unit, vid, theta, w)): origins of dead ends by the most that a whole demand of theirs may be before their way to the vertex jams."""
    _, told = carried(levels, weights.select("unit", "vid", F.col("w").alias("amount")), False)
    inf = F.lit(float("inf"))
    rest = weights.select("unit", "vid", "w", inf.alias("theta"), F.lit(False).alias("moved"))
    for level in told:
        way = level.filter("amount > 0").select("unit", "vid", "up", (F.col("cap") / F.col("amount")).alias("here"))
        joined = rest.join(way, ["unit", "vid"], "left")
        moved = F.col("up").isNotNull()
        rest = joined.select("unit", F.coalesce("up", "vid").alias("vid"), "w", F.when(moved, F.least("theta", "here")).otherwise(F.col("theta")).alias("theta"), (F.col("moved") | moved).alias("moved"))
        rest = written(rest.groupBy("unit", "vid", "theta", "moved").agg(F.sum("w").alias("w")), "dead-ends-hung")
    out = rest.groupBy("unit", "vid").agg(F.sum("w").alias("w"))
    return out, rest.filter("moved").select("unit", "vid", "theta", "w")
