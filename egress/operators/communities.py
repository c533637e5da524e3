"""Tables of communities: ranking, evacuation of one group, and what policies buy.

States to compare (hazard left out, lanes reversed, roads widened, extra roads) are scenarios:
a unit of a run is (of, state), and the scenarios of all communities run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.functions.roads import finite_ratio
from egress.operators.evacuation import clearance, contraflow, ladder, selfish, two_lanes
from egress.operators.flow import accessibility, cut_arcs, managed, managed_flow, most_flow, times
from egress.operators.regions import of_arcs
from egress.operators.spatial import near_polygons, nearest
from egress.plans.store import written

INF = float("inf")


def _in(state: str, df: DataFrame) -> DataFrame:
    """``df`` with unit (of, state), the state from a column."""
    return df.withColumn("unit", F.struct(F.col("unit").alias("of"), F.col(state).alias("state")))


def _each(states: list[str], df: DataFrame) -> DataFrame:
    """Every row once for each state."""
    return df.withColumn("unit", F.explode(F.array(*[F.struct(F.col("unit").alias("of"), F.lit(s).alias("state")) for s in states])))


def inside(arcs: DataFrame, members: DataFrame) -> DataFrame:
    """Arcs with ``inner``: whether both ends are among the unit's members."""
    own = members.select("unit", "vid").distinct()
    ends = [own.select("unit", F.col("vid").alias(c), F.lit(True).alias(f"{c}_in")) for c in ("src", "dst")]
    joined = arcs.join(ends[0], ["unit", "src"], "left").join(ends[1], ["unit", "dst"], "left")
    return joined.select(*arcs.columns, F.coalesce(F.col("src_in") & F.col("dst_in"), F.lit(False)).alias("inner"))


def complete(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(group): groups (group, name) all of whose names are ``known`` (name)."""
    lacking = groups.join(known.select("name").distinct(), "name", "left_anti").select("group").distinct()
    return groups.select("group").distinct().join(lacking, "group", "left_anti")


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` without the columns whose names start so, as before one policy's columns are worked out anew."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def near_arcs(arcs: DataFrame, communities: DataFrame, most: float, size: float) -> DataFrame:
    """(unit, eid): arcs (eid, x0, y0, x1, y1) whose middle is at most so far from a community's polygon (unit, rings or ring): those of a long road that a unit may widen."""
    middle = arcs.select("eid", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return near_polygons(middle, communities, most, size).select("unit", "eid").distinct()


def demand(blocks: DataFrame, members: DataFrame, reach: DataFrame, even: DataFrame | None = None) -> DataFrame:
    """(unit, vid, w): vehicles of blocks (unit, block, x, y, veh) at the nearest of the unit's members (unit, vid, x, y), where a target can be reached.

    Units in ``even`` (unit), and those without blocks, have weight 1 on each member that
    reaches a target.
    """
    ok = reach.select("unit", "vid")
    near = nearest(blocks.select("unit", F.col("block").alias("qid"), "x", "y"), members.select("unit", F.col("vid").alias("sid"), "x", "y"), ["unit"])
    placed = near.withColumnRenamed("qid", "block").join(blocks.select("unit", "block", "veh"), ["unit", "block"]).groupBy("unit", F.col("sid").alias("vid")).agg(F.sum("veh").cast("double").alias("w"))
    flat = members.select("unit").distinct().join(blocks.select("unit").distinct(), "unit", "left_anti")
    flat = flat if even is None else flat.union(even.select("unit")).distinct()
    own = placed.join(flat, "unit", "left_anti").unionByName(members.select("unit", "vid").join(flat, "unit", "left_semi").withColumn("w", F.lit(1.0)))
    return own.filter("w > 0").join(ok, ["unit", "vid"], "left_semi")


def rank_communities(arcs: DataFrame, members: DataFrame, targets: DataFrame, weights: DataFrame, people: DataFrame, free_of: dict[str, int], threshold: int) -> DataFrame:
    """One row per unit of ``people`` (unit, population, vehicles), the most people for each unit of capacity first, unknown last.

    Arcs (unit, eid, src, dst, capacity_vph, travel_s, hazard_max). Besides the measures of
    :func:`accessibility`: n_disjoint, capacity and cut_off without the arcs of some hazard or
    more outside the unit (``free_of``: suffix and least hazard left out); vehicles on nodes
    without a way out; managed and self-routed throughput, hours and gaps; and a note where
    there is nothing to route.
    """
    parted = inside(arcs, members)
    states = ["all", *free_of]
    keep = F.lit(False)
    for state, least in free_of.items():
        keep = keep | ((F.col("unit.state") == state) & ((F.col("hazard_max") < least) | F.col("inner")))
    per_state = _each(states, parted).filter((F.col("unit.state") == "all") | keep).drop("inner")
    pop = people.select("unit", "population")
    found = written(accessibility(per_state, _each(states, members.select("unit", "vid")), _each(states, targets.select("unit", "vid")), threshold, _each(states, pop)), "rank-access")
    out = people.join(found.filter("unit.state = 'all'").withColumn("unit", F.col("unit.of")).drop("population", "n_vertices"), "unit", "left")
    out = out.join(members.groupBy("unit").agg(F.countDistinct("vid").alias("n_nodes")), "unit", "left").na.fill(0, ["n_nodes"])
    for state in free_of:
        own = found.filter(F.col("unit.state") == state)
        out = out.join(own.select(F.col("unit.of").alias("unit"), *[F.col(c).alias(f"{n}_nohaz_{state}") for c, n in (("n_disjoint", "n_disjoint"), ("capacity_vph", "capacity"), ("cut_off", "cut_off"))]), "unit", "left")
    reach = times(arcs, targets)
    placed = weights.filter("w > 0").join(reach, ["unit", "vid"], "left")
    stranded = placed.groupBy("unit").agg(F.sum(F.when(F.col("dist").isNull(), F.col("w")).otherwise(0.0)).alias("stranded_vehicles"), F.count("dist").alias("origins"))
    own = placed.filter("dist IS NOT NULL").select("unit", "vid", "w")
    upper = written(out.filter(F.col("capacity_vph") > 0).filter(F.col("capacity_vph") < INF).select("unit", F.col("capacity_vph").alias("upper")).join(own.select("unit").distinct(), "unit", "left_semi"), "rank-upper")
    some = upper.select("unit")
    routed = [df.join(some, "unit", "left_semi") for df in (arcs, own, targets)]
    bound = written(managed(*routed, upper=upper)[0], "rank-managed")
    totals = own.groupBy("unit").agg(F.sum("w").alias("total"))
    shares = routed[1].join(totals, "unit").select("unit", "vid", (F.col("w") / F.col("total")).alias("w"))
    roads = routed[0].select("unit", "eid", "src", "dst", F.col("capacity_vph").cast("double").alias("cap"), F.col("travel_s").alias("t0"))
    told = selfish(roads, shares, routed[2], bound)
    told = clearance(told.join(people.select("unit", "vehicles"), "unit")).drop("vehicles")
    out = out.join(told, "unit", "left").join(stranded, "unit", "left").na.fill(0.0, ["stranded_vehicles"])
    note = F.when(F.col("n_nodes") == 0, "no node inside").when(F.coalesce("tt_min", F.lit(INF)) == INF, "no route to any target").when(F.coalesce("origins", F.lit(0)) == 0, "no vehicles in its blocks")
    return out.withColumn("note", note).drop("origins").orderBy(F.col("people_per_capacity").desc_nulls_last(), "unit")


def hours(arcs: DataFrame, weights: DataFrame, targets: DataFrame, load: DataFrame, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(unit, managed_vph, h) of each unit of ``load`` (unit, vehicles, upper), infinite without origins, capacity or throughput; and the binding arcs."""
    able = load.filter((F.col("upper") > 0) & (F.col("upper") < INF)).join(weights.filter("w > 0").select("unit").distinct(), "unit", "left_semi")
    some = written(able.select("unit", "upper"), "hours-units")
    if some.isEmpty():
        none = load.select("unit", F.lit(0.0).alias("managed_vph"), F.lit(INF).alias("h"))
        return none, arcs.select("unit", "eid", "src", "dst", F.col("capacity_vph").alias("cap")).limit(0)
    bound, binding = managed(*[df.join(some.select("unit"), "unit", "left_semi") for df in (arcs, weights, targets)], upper=some, regions=regions)
    told = load.join(bound, "unit", "left").select("unit", F.coalesce("managed_vph", F.lit(0.0)).alias("managed_vph"), "vehicles")
    return written(told.select("unit", "managed_vph", finite_ratio(F.col("vehicles"), F.col("managed_vph")).alias("h")), "hours"), binding


def with_contraflow(arcs: DataFrame, weights: DataFrame, targets: DataFrame, load: DataFrame, base: DataFrame, rounds: int = 3, regions: DataFrame | None = None) -> DataFrame:
    """(unit, h, km): least hours over rounds that each reverse the arcs that bind, and the km reversed by then. A round that doesn't help is kept, since the next may; ``base``: (unit, h) as it is."""
    best = base.select("unit", "h", F.lit(0.0).alias("km"))
    now, done = arcs, base.select("unit", F.lit(0.0).alias("km"))
    wide = load.withColumn("upper", F.col("upper") * 2)
    _, binding = hours(now, weights, targets, wide, regions)
    for _ in range(rounds):
        turned, metres = contraflow(now, binding.select("unit", "eid"))
        now = written(turned, "contraflow-arcs")
        done = written(done.join(metres, "unit", "left").select("unit", (F.col("km") + F.coalesce("metres", F.lit(0.0)) / 1000).alias("km")), "contraflow-km")
        found, binding = hours(now, weights, targets, wide, regions)
        both = best.withColumnsRenamed({"h": "h0", "km": "km0"}).join(found, "unit").join(done, "unit")
        better = F.col("h") < F.col("h0") - 1e-6
        best = written(both.select("unit", F.when(better, F.col("h")).otherwise(F.col("h0")).alias("h"), F.when(better, F.col("km")).otherwise(F.col("km0")).alias("km")), "contraflow-best")
    return best


def widened(arcs: DataFrame, weights: DataFrame, targets: DataFrame, load: DataFrame, base: DataFrame, enough: float = 1.0, steps: int = 5, near: DataFrame | None = None, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(unit, h, lane_km) after up to ``steps`` widenings, and these: (unit, step, road_key, h, km).

    A step gives each arc of one road (road_key) a lane (per_lane), of those in ``near`` (unit, eid) if it is given. Of the roads that bind, it
    takes the one with the fewest hours, then the fewest lane km, then the first key; a unit
    stops when no road helps, or at ``enough`` hours. All roads of all units are tried side by
    side.
    """
    wide = load.withColumn("upper", F.col("upper") * 3)
    own = arcs.columns
    if near is None:
        now = arcs.withColumn("_near", F.lit(True))
    else:
        now = written(arcs.join(near.select("unit", "eid", F.lit(True).alias("_near")).distinct(), ["unit", "eid"], "left").na.fill(False, ["_near"]).select(*own, "_near"), "widen-arcs")
    cur, told = written(base.select("unit", "h", F.lit(0.0).alias("lane_km")), "widen-hours"), None
    _, binding = hours(now, weights, targets, wide, regions)
    for step in range(1, steps + 1):
        running = cur.filter(F.col("h") > enough).select("unit")
        keys = binding.select("unit", "eid").join(now.select("unit", "eid", "road_key"), ["unit", "eid"]).filter("road_key IS NOT NULL").select("unit", F.col("road_key").alias("state")).distinct().join(running, "unit", "left_semi")
        keys = written(keys, "widen-keys")
        if keys.isEmpty():
            break
        spread = lambda df: _in("state", df.join(keys, "unit"))  # noqa: B023, E731
        mine = (F.col("road_key") == F.col("state")) & F.col("_near")
        tried = written(spread(now).withColumn("capacity_vph", F.col("capacity_vph") + F.when(mine, F.col("per_lane")).otherwise(0.0)).withColumn("own", F.coalesce(mine, F.lit(False))), "widen-tried")
        found, bound = hours(tried.drop("own", "state"), spread(weights).drop("state"), spread(targets).drop("state"), spread(wide).drop("state"), regions)
        km = tried.filter("own").groupBy("unit").agg((F.sum("length_m") / 1000).alias("lane_km"))
        pick = F.min(F.struct("h", "lane_km", F.col("unit.state").alias("road_key"))).alias("x")
        chosen = found.join(km, "unit").groupBy(F.col("unit.of").alias("unit")).agg(pick).join(cur.withColumnRenamed("h", "before"), "unit").filter("x.h < before - 1e-6")
        chosen = written(chosen.select("unit", F.lit(step).alias("step"), "x.road_key", "x.h", "x.lane_km", F.col("lane_km").alias("km_before")), "widen-step")
        if chosen.isEmpty():
            break
        step_row = chosen.select("unit", "step", "road_key", "h", F.col("lane_km").alias("km"))
        told = step_row if told is None else told.unionByName(step_row)
        cur = written(cur.join(chosen, "unit", "left_anti").unionByName(chosen.select("unit", "h", (F.col("km_before") + F.col("lane_km")).alias("lane_km"))), "widen-hours")
        state = chosen.select("unit", F.col("road_key").alias("state"))
        now = written(tried.drop("own", "state").select(F.col("unit.of").alias("unit"), F.col("unit.state").alias("state"), *[c for c in own if c != "unit"], "_near").join(state, ["unit", "state"], "left_semi").select(*own, "_near"), "widen-arcs")
        binding = written(bound.select(F.col("unit.of").alias("unit"), F.col("unit.state").alias("state"), "eid").join(state, ["unit", "state"], "left_semi").drop("state"), "widen-binding")
    none = cur.select("unit", F.lit(0).alias("step"), F.lit("").alias("road_key"), "h", F.col("lane_km").alias("km")).limit(0)
    return cur, none if told is None else told


def with_extra(arcs: DataFrame, extra: DataFrame, members: DataFrame, targets: DataFrame, weights: DataFrame, vehicles: DataFrame, least: int = 3, regions: DataFrame | None = None) -> DataFrame:
    """What extra roads buy: (unit, n_without, n_with, h_without, h_with, km_used), the hours without arcs of hazard ``least`` or more outside the unit.

    Members are those on an ordinary arc, and demand starts only where a target is in reach
    without extra roads, so both states are of the same vehicles. km_used: extra arcs that
    carry traffic in one plan that works.
    """
    on = arcs.select("unit", F.col("src").alias("vid")).union(arcs.select("unit", "dst")).distinct()
    own = written(members.select("unit", "vid").distinct().join(on, ["unit", "vid"], "left_semi"), "extra-members")
    regions = of_arcs(arcs.select("src", "dst").union(extra.select("src", "dst"))) if regions is None else regions
    every = arcs.withColumn("is_extra", F.lit(False)).unionByName(extra.withColumn("is_extra", F.lit(True)))
    states = ["with", "without"]
    parted = written(_each(states, inside(every, own)).filter("unit.state = 'with' OR NOT is_extra"), "extra-arcs")
    goals = _each(states, targets.select("unit", "vid"))
    access = written(accessibility(parted, _each(states, own), goals, least, regions=regions), "extra-access")
    start = weights.join(own, ["unit", "vid"], "left_semi").join(times(arcs, targets, regions).select("unit", "vid"), ["unit", "vid"], "left_semi")
    calm = parted.filter((F.col("hazard_max") < least) | F.col("inner"))
    load = _each(states, vehicles.select("unit", "vehicles")).join(access.select("unit", F.col("capacity_vph").alias("upper")), "unit")
    found, _ = hours(calm, _each(states, start), goals, load, regions)
    some = written(found.filter("unit.state = 'with' AND managed_vph > 0").select("unit", F.col("managed_vph").alias("d")), "extra-demand")
    used = some.select("unit", F.lit(0.0).alias("km_used")).limit(0)
    if not some.isEmpty():
        plan = managed_flow(*[df.join(some.select("unit"), "unit", "left_semi") for df in (calm, _each(states, start), goals)], some, regions)
        used = plan.filter("flow > 1e-6").join(calm.filter("is_extra").select("unit", "eid", "length_m"), ["unit", "eid"]).groupBy("unit").agg((F.sum("length_m") / 1000).alias("km_used"))
    row = access.select("unit", "n_disjoint").join(found.select("unit", "h"), "unit", "left").join(used, "unit", "left")
    pick = lambda c, s: F.max(F.when(F.col("unit.state") == s, F.col(c)))
    return row.groupBy(F.col("unit.of").alias("unit")).agg(*[pick("n_disjoint", s).alias(f"n_{s}") for s in ("without", "with")], *[pick("h", s).alias(f"h_{s}") for s in ("without", "with")], F.coalesce(F.max("km_used"), F.lit(0.0)).alias("km_used"))


def policy_table(arcs: DataFrame, members: DataFrame, targets: DataFrame, weights: DataFrame, vehicles: DataFrame, selfish_h: DataFrame | None = None, extra: DataFrame | None = None, slow: float = 2.0, fast: float = 1.0, near: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """One row per unit of ``vehicles`` (unit, vehicles): clearance hours, rungs, and what each policy brings (self-routed as it is, contraflow, widening, extra roads).

    Arcs also have length_m, road_key and per_lane. ``selfish_h``: (unit, h) of an earlier
    ranking. A unit without a member has nulls. ``near``: (unit, eid) that may be widened.
    ``regions``: (vid, region), else by id.
    """
    parted = inside(arcs, members)
    access = written(accessibility(arcs, members, targets, 3, regions=regions).select("unit", "n_disjoint", F.col("capacity_vph").alias("upper")), "policy-access")
    start = written(weights.join(times(arcs, targets, regions).select("unit", "vid"), ["unit", "vid"], "left_semi"), "policy-weights")
    load = written(vehicles.join(access.select("unit", "upper"), "unit").na.fill(0.0, ["upper"]), "policy-load")
    states = ["base", "vh", "h"]
    kept = (F.col("unit.state") == "base") | F.col("inner") | ((F.col("unit.state") == "vh") & (F.col("hazard_max") < 3)) | (F.col("hazard_max") < 2)
    found, _ = hours(_each(states, parted).filter(kept).drop("inner"), _each(states, start), _each(states, targets), _each(states, load), regions)
    of = lambda s: found.filter(F.col("unit.state") == s).select(F.col("unit.of").alias("unit"), "h")
    base = written(of("base"), "policy-base")
    out = vehicles.join(access.select("unit", "n_disjoint"), "unit", "left").join(base.withColumnRenamed("h", "clear_h_managed"), "unit", "left").join(of("vh").withColumnRenamed("h", "clear_h_vh_free"), "unit", "left").join(of("h").withColumnRenamed("h", "clear_h_h_free"), "unit", "left")
    meets = {"L1": F.col("n_disjoint") >= 2, "L2": F.col("clear_h_managed") <= slow, "L3": F.col("clear_h_managed") <= fast, "L4": F.col("clear_h_vh_free") <= fast, "L5": F.col("clear_h_h_free") <= fast}
    out = out.withColumns({f"meets_{k}": v for k, v in meets.items()})
    out = out.withColumn("ladder_rung", ladder(F.col("n_disjoint"), F.col("clear_h_managed"), F.col("clear_h_vh_free"), F.col("clear_h_h_free"), slow, fast))
    if selfish_h is not None:
        out = out.join(selfish_h.select("unit", F.col("h").alias("I1_selfish_last_h")), "unit", "left")
    turned = with_contraflow(arcs, start, targets, load, base, regions=regions)
    out = out.join(turned.withColumnsRenamed({"h": "I2_contraflow_h", "km": "I2_contraflow_km"}), "unit", "left")
    wide, steps = widened(arcs, start, targets, load, base, fast, near=near, regions=regions)
    listed = steps.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "road_key"))), lambda x: x["road_key"]), "; ").alias("I3_steps"))
    out = out.join(wide.withColumnsRenamed({"h": "I3_widen_h", "lane_km": "I3_lane_km"}), "unit", "left").join(listed, "unit", "left").na.fill("", ["I3_steps"])
    if extra is not None:
        bought = with_extra(arcs, extra, members, targets, weights, vehicles)
        out = out.join(bought.withColumnsRenamed({"n_without": "I4_n_disjoint_without", "n_with": "I4_n_disjoint_with", "h_without": "I4_vh_free_h_without", "h_with": "I4_vh_free_h_with", "km_used": "I4_fire_road_km_used"}), "unit", "left")
    return out


def retro_group(arcs: DataFrame, members: DataFrame, targets: DataFrame, weights: DataFrame, vehicles: float, burned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A group of communities evacuated as one origin: (summary, cut, binding).

    Arcs (eid, src, dst, capacity_vph, travel_s, hazard_max, road_class, lanes_imputed), members
    and targets (vid), weights (vid, w), ``burned`` (eid): arcs within the final perimeter. Cut
    and binding arcs keep all columns, with in_perimeter. The summary is one row: routes, cut
    capacity, throughputs, hours, shares of the cuts within the perimeter, and the same with
    two lanes on untagged roads.
    """
    one = lambda df: df.withColumn("unit", F.lit("group"))
    goals, people = one(targets.select("vid").distinct()), one(members.select("vid").distinct())
    states = ["now", "two_lanes"]
    both = written(_each(["now"], one(arcs)).unionByName(_each(["two_lanes"], one(two_lanes(arcs)))), "retro-arcs")
    access = written(accessibility(both, _each(states, people), _each(states, goals), 1), "retro-access")
    start = written(one(weights).filter("w > 0").join(times(one(arcs), goals).select("unit", "vid"), ["unit", "vid"], "left_semi"), "retro-weights")
    load = access.select("unit", F.col("capacity_vph").alias("upper")).withColumn("vehicles", F.lit(float(vehicles)))
    found, binding = hours(both, _each(states, start), _each(states, goals), load)
    caps = one(arcs).withColumn("cap", F.col("capacity_vph").cast("double"))
    away = people.join(goals, ["unit", "vid"], "left_anti")
    reach = most_flow(caps, away.withColumn("amount", F.lit(1e12)), goals)[1]
    marked = burned.select("eid", F.lit(True).alias("in_perimeter")).distinct()
    flagged = lambda df: df.join(marked, "eid", "left").na.fill(False, ["in_perimeter"])
    cut = written(flagged(cut_arcs(caps, reach).drop("unit", "cap")), "retro-cut")
    bind = written(flagged(arcs.join(binding.filter("unit.state = 'now'").select("eid"), "eid", "left_semi")), "retro-binding")
    bound = found.filter("unit.state = 'now'").select(F.lit("group").alias("unit"), "managed_vph")
    total = start.agg(F.sum("w")).first()[0] or 1.0
    roads = one(arcs).select("unit", "eid", "src", "dst", F.col("capacity_vph").cast("double").alias("cap"), F.col("travel_s").alias("t0"))
    told = clearance(selfish(roads, start.withColumn("w", F.col("w") / total), goals, bound).withColumn("vehicles", F.lit(float(vehicles))))
    share = lambda df, name: df.agg((F.sum(F.when(F.col("in_perimeter"), F.col("capacity_vph")).otherwise(0.0)) / F.sum("capacity_vph")).alias(f"{name}_share_in_perimeter"), F.sum("capacity_vph").alias(f"{name}_capacity_vph"))
    pick = lambda df, s, *cols: df.filter(F.col("unit.state") == s).select(F.lit("group").alias("unit"), *cols)
    out = told.join(pick(access, "now", "n_disjoint"), "unit").join(pick(access, "two_lanes", F.col("capacity_vph").alias("sens_2lane_mincut_vph")), "unit")
    out = out.join(pick(found, "two_lanes", F.col("managed_vph").alias("sens_2lane_managed_vph"), F.col("h").alias("sens_2lane_clear_h_managed")), "unit")
    out = out.join(one(share(cut, "mincut")), "unit").join(one(share(bind, "binding")), "unit")
    return out.drop("unit"), cut, bind
