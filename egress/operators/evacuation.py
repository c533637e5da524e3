"""Clearance, safety ladder, demand and the fixes that can be bought, as column arithmetic and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from egress.functions.roads import finite_ratio
from egress.operators.deadends import hung, peeled
from egress.operators.nearby import Nearby
from egress.operators.regions import of_arcs
from egress.operators.routing import settle
from egress.plans.store import written


def clearance(rows: DataFrame) -> DataFrame:
    """Adds hours and gaps to (vehicles, managed_vph, rationed_vph, strict_vph): infinite hours without throughput, gaps null without managed throughput. The gap in bulk is never negative; its hours may be fewer than the managed ones."""
    bulk = F.least("rationed_vph", "managed_vph")
    gap = lambda v: F.when(F.col("managed_vph") > 0, 1 - v / F.col("managed_vph"))
    return rows.withColumns(
        {
            "managed_h": finite_ratio(F.col("vehicles"), F.col("managed_vph")),
            "bulk_h": finite_ratio(F.col("vehicles"), F.col("rationed_vph")),
            "last_h": finite_ratio(F.col("vehicles"), F.col("strict_vph")),
            "gap_bulk": gap(bulk),
            "gap_last": gap(F.col("strict_vph")),
        }
    )


def ladder(routes: Column, base_h: Column, free_h: Column, freer_h: Column, slow: float = 2.0, fast: float = 1.0) -> Column:
    """Rungs reached without a gap: two routes; cleared in ``slow`` hours; in ``fast`` hours; the same without very high hazard; without high hazard."""
    rungs = [routes >= 2, base_h <= slow, base_h <= fast, free_h <= fast, freer_h <= fast]
    out = F.lit(len(rungs))
    for k in reversed(range(len(rungs))):
        out = F.when(F.coalesce(rungs[k], F.lit(False)), out).otherwise(F.lit(k))
    return out


def ladder_share(rows: DataFrame) -> DataFrame:
    """(rung, n, population, share) of (rung, population)."""
    return rows.groupBy("rung").agg(F.count("*").alias("n"), F.sum("population").alias("population")).withColumn("share", F.col("population") / F.sum("population").over(Window.partitionBy(F.lit(0))))


def vehicles_by_block(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """(block, veh): a group's vehicles dealt to its blocks by housing; 0 without housing. Blocks (block, grp, housing), groups (grp, vehicles)."""
    totals = blocks.groupBy("grp").agg(F.sum("housing").alias("total"))
    joined = blocks.join(totals, "grp").join(groups, "grp", "left")
    return joined.select("block", F.when(F.col("total") > 0, F.col("housing") / F.col("total") * F.coalesce("vehicles", F.lit(0))).otherwise(0.0).alias("veh"))


def contraflow(arcs: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs with new capacity_vph, metres): chosen arcs (eid), in order of their ids, take what capacity their reverse arc has left, which then has none.

    The reverse of an arc is the least arc between the same vertices the other way. Arcs
    without one, or whose reverse is empty by then, stay as they are; of two arcs that are
    each other's reverse the later takes all back. Metres are the length of the takers.
    With a column ``unit`` in both tables each unit has its own capacities. An order only
    matters between the same two vertices, so the rule is a fold over the chosen arcs of
    such a pair; those are as few as its parallel roads.
    """
    by = ["unit"] if "unit" in arcs.columns else []
    forth = F.col("src") < F.col("dst")
    placed = arcs.filter("src != dst").withColumns({"p": F.least("src", "dst"), "q": F.greatest("src", "dst"), "forth": forth})
    first = lambda way: F.min(F.when(F.col("forth") == way, F.struct("eid", F.col("capacity_vph").cast("double").alias("cap"))))
    asked = placed.join(chosen.select(*by, "eid").distinct(), [*by, "eid"], "left_semi").select(*by, "p", "q", F.struct("eid", "forth", F.col("length_m").cast("double").alias("length_m")).alias("x"))
    wants = asked.groupBy(*by, "p", "q").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = placed.join(wants.select(*by, "p", "q"), [*by, "p", "q"], "left_semi").groupBy(*by, "p", "q").agg(first(True).alias("one"), first(False).alias("two"))
    took = "array<struct<eid:bigint,extra:double,length_m:double>>"
    state = f"struct<a:double,b:double,took:{took}>"
    zero = F.lit(0.0)

    def step(acc: Column, x: Column) -> Column:
        extra = F.when(x["forth"], acc["b"]).otherwise(acc["a"])
        into = lambda this, other: F.when(x["eid"] == this["eid"], other).otherwise(zero)
        a = F.when(x["forth"], acc["a"] + into(F.col("one"), extra)).otherwise(zero)
        b = F.when(x["forth"], zero).otherwise(acc["b"] + into(F.col("two"), extra))
        more = F.concat(acc["took"], F.array(F.struct(x["eid"].cast("bigint").alias("eid"), extra.alias("extra"), x["length_m"].alias("length_m"))))
        return F.when(extra > 0, F.struct(a.alias("a"), b.alias("b"), more.alias("took")).cast(state)).otherwise(acc)

    start = F.struct(F.coalesce("one.cap", zero).alias("a"), F.coalesce("two.cap", zero).alias("b"), F.array().cast(took).alias("took")).cast(state)
    done = written(pairs.join(wants, [*by, "p", "q"]).withColumn("end", F.aggregate("xs", start, step)), "contraflow")
    takers = done.select(*by, F.col("one.eid").alias("one"), F.col("two.eid").alias("two"), F.explode("end.took").alias("x"))
    gained = takers.filter("x.eid != coalesce(one, -1) AND x.eid != coalesce(two, -1)").select(*by, "x.eid", "x.extra", F.lit(None).cast("double").alias("now"))
    heads = [done.filter(f"{x}.eid IS NOT NULL").select(*by, F.col(f"{x}.eid").alias("eid"), zero.alias("extra"), F.col(f"end.{c}").alias("now")) for x, c in (("one", "a"), ("two", "b"))]
    change = gained.unionByName(heads[0]).unionByName(heads[1])
    out = arcs.join(change, [*by, "eid"], "left").withColumn("capacity_vph", F.coalesce("now", F.col("capacity_vph") + F.coalesce("extra", zero)))
    total = takers.groupBy(*by) if by else takers
    return out.select(*arcs.columns), total.agg(F.coalesce(F.sum("x.length_m"), zero).alias("metres"))


def widen(arcs: DataFrame, eid: int, add_vph: float) -> DataFrame:
    return arcs.withColumn("capacity_vph", F.col("capacity_vph") + F.when(F.col("eid") == eid, F.lit(add_vph)).otherwise(F.lit(0.0)))


def two_lanes(arcs: DataFrame) -> DataFrame:
    """Capacities if untagged primary, secondary and tertiary roads had twice the lanes."""
    doubled = F.col("lanes_imputed") & F.col("road_class").isin("primary", "secondary", "tertiary")
    return arcs.withColumn("capacity_vph", F.col("capacity_vph") * F.when(doubled, 2).otherwise(1))


def exit_class(free: Column, routes: Column) -> Column:
    """no-exit: nothing avoids the hazard; avoids: as many routes as ever; partly: fewer."""
    return F.when(free == 0, "no-exit").when(free >= routes, "avoids").otherwise("partly")


# --- routes that drivers choose themselves ------------------------------------------------------


#: Demands of the rationed scan, as parts of the managed demand: a quarter to three times, in equal ratios.
SCAN = [0.25 * 12 ** (k / 7) for k in range(8)]


#: Halvings of the bisection that are answered by one run: all demands that they could ask for are scenarios of it.
STAGES = (3, 2, 2)


def selfish(arcs: DataFrame, weights: DataFrame, targets: DataFrame, managed: DataFrame, stages: tuple[int, ...] = STAGES, regions: DataFrame | None = None) -> DataFrame:
    """(unit, managed_vph, strict_vph, rationed_vph, strict_converged, rationed_converged) of drivers who route themselves.

    Strict: managed itself if no arc is overloaded and everyone has a way out, else what
    bisection of the managed demand finds. Rationed: the larger of strict and the most that is
    delivered over the scanned demands. The scan and managed itself are settled side by side,
    as scenarios of one run; where managed doesn't fit, each stage settles the few demands
    that its halvings could ask for and walks over the answers. In networks of several regions drivers are
    settled around their origins if none of them gets to the edge of that. The flags tell whether the
    ways of the demand behind each figure came to rest (else they oscillate); null where no demand fits.
    """
    grid = 1 << sum(stages)
    off = peeled(arcs.withColumnRenamed("t0", "cost"), targets, single=True)
    stubs = None
    if off.levels:
        arcs = off.core.withColumnRenamed("cost", "t0")
        weights, stubs = (written(df, "selfish-origins") for df in hung(off.levels, weights))
    regions = of_arcs(arcs, others=(weights, targets)) if regions is None else regions
    parted = regions.select("region").distinct().count() > 1
    near = Nearby(arcs, weights.filter("w > 0"), targets) if parted else ()

    def settled(asked: DataFrame) -> DataFrame:
        """Scenarios (of, kind, k, d) as units of one run: their fit and delivery."""
        rest, told = written(asked.select("of", F.struct("of", "kind", "k").alias("unit"), "d"), "selfish-scenarios"), []

        def routed(each: DataFrame, where: DataFrame, streets: DataFrame, origins: DataFrame, goals: DataFrame, edge: DataFrame | None = None) -> DataFrame:
            spread = lambda df: None if df is None else df.withColumnRenamed("unit", "of").join(each.select("unit", "of"), "of").drop("of")
            return settle(*map(spread, (streets, origins, goals)), each.select("unit", "d"), regions=where, hung=spread(stubs), edge=spread(edge))

        for zone in near:
            some = rest.join(zone.units.withColumnRenamed("unit", "of"), "of", "left_semi").select(rest.columns)
            if some.isEmpty():
                break
            told.append(routed(some, zone.regions, zone.arcs, weights.filter("w > 0"), zone.targets, zone.edge))
            rest = written(rest.join(told[-1].select("unit"), "unit", "left_anti").select(rest.columns), "selfish-scenarios")
            if rest.isEmpty():
                break
        if not told or not rest.isEmpty():
            told.append(routed(rest, regions, arcs, weights, targets))
        return written(reduce(DataFrame.unionByName, told).select("unit.of", "unit.kind", "unit.k", "delivered", "converged", F.expr("ratio <= 1 + 1e-9 AND unreachable <= 1e-12").alias("fits")), "selfish-told")

    some = managed.filter("managed_vph > 0").select(F.col("unit").alias("of"), F.col("managed_vph").alias("most"))
    first = [("b", grid, 1.0)] + [("s", k, f) for k, f in enumerate(SCAN)]
    scenario = F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(k).alias("k"), F.lit(f).alias("part")) for a, k, f in first]))
    told = settled(some.withColumn("x", scenario).select("of", "x.kind", "x.k", (F.col("x.part") * F.col("most")).alias("d")))
    best = told.filter("kind = 's'").groupBy("of").agg(F.max(F.struct("delivered", -F.col("k"), "converged")).alias("x")).select("of", F.col("x.delivered").alias("best"), F.col("x.converged").alias("best_rests"))
    done = told.filter("kind = 'b' AND fits").select("of", F.lit(grid).alias("low"), F.col("converged").alias("rests"))
    low = written(some.join(done, "of", "left_anti").withColumns({"low": F.lit(0), "rests": F.lit(None).cast("boolean")}), "selfish-low")
    width = grid
    for halvings in stages:
        if low.isEmpty():
            break
        step = width >> halvings
        ask = F.explode(F.array(*[F.lit(k * step) for k in range(1, 1 << halvings)]))
        told = settled(low.withColumn("ask", ask).withColumn("k", F.col("low") + F.col("ask")).select("of", F.lit("b").alias("kind"), "k", (F.col("k") / grid * F.col("most")).alias("d")))
        good = low.join(told.filter("fits").groupBy("of").agg(F.collect_list(F.struct("k", "converged")).alias("good")), "of", "left").withColumn("good", F.coalesce("good", F.array().cast("array<struct<k:int,converged:boolean>>")))
        now = F.col("low")
        for h in range(1, halvings + 1):
            now = now + F.when(F.array_contains("good.k", (now + (width >> h)).cast("int")), width >> h).otherwise(0)
        walked = good.withColumn("now", now.cast("int"))
        here = F.get(F.filter("good", lambda g: g["k"] == F.col("now")), F.lit(0))["converged"]
        low = written(walked.select("of", "most", F.col("now").alias("low"), F.when(F.col("now") == F.col("low"), F.col("rests")).otherwise(here).alias("rests")), "selfish-low")
        width = step
    parts = done.unionByName(low.select("of", "low", "rests"))
    out = managed.join(parts.withColumnRenamed("of", "unit"), "unit", "left").join(best.withColumnRenamed("of", "unit"), "unit", "left")
    strict = F.coalesce(F.col("managed_vph") * F.col("low") / grid, F.lit(0.0))
    most = F.coalesce("best", F.lit(0.0))
    flag = F.when(most > strict, F.col("best_rests")).otherwise(F.col("rests")).alias("rationed_converged")
    return out.select("unit", "managed_vph", strict.alias("strict_vph"), F.greatest(strict, most).alias("rationed_vph"), F.col("rests").alias("strict_converged"), flag)
