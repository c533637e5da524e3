"""Relational graph operators over vertex and arc tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from egress.functions.ranks import ranked
from egress.operators import hops
from egress.operators.components import components, labelled_links
from egress.plans.store import released, written


def dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """``df`` in so many parts by columns, as it is if ``parts`` is None. A step on these columns keeps the parts, so a task's share is known beforehand."""
    return df if parts is None else df.repartition(parts, *by)


def undirected_unique(pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """(src, dst) with src < dst of raw pairs (a, b), each once, without loops."""
    return dealt(pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).filter("src < dst"), parts, "src", "dst").distinct()


def to_directed(edges: DataFrame) -> DataFrame:
    """Two arcs for each edge."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def degree(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, degree): arc ends at each vertex, 0 included; a loop counts twice."""
    ends = arcs.select(F.col("src").alias("vid")).union(arcs.select("dst"))
    return vertices.select("vid").join(ends.groupBy("vid").agg(F.count("*").alias("degree")), "vid", "left").na.fill(0, ["degree"])


def induced(arcs: DataFrame, keep: DataFrame) -> DataFrame:
    """Arcs with both ends in ``keep`` (vid)."""
    ids = keep.select("vid")
    return arcs.join(ids.withColumnRenamed("vid", "src"), "src", "left_semi").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi").select(*arcs.columns)


def node_flags(arcs: DataFrame, vertices: DataFrame, classes: tuple[str, ...] = ("motorway", "trunk", "primary")) -> DataFrame:
    """(vid, on_<class>...): whether an arc of the class starts or ends at the vertex. Link classes don't count."""
    ends = arcs.select(F.col("src").alias("vid"), "road_class").union(arcs.select("dst", "road_class"))
    flags = ends.filter(F.col("road_class").isin(*classes)).groupBy("vid").agg(*[F.max(F.col("road_class") == c).alias(f"on_{c}") for c in classes])
    return vertices.select("vid").join(flags, "vid", "left").na.fill(False)


def reverse_arcs(arcs: DataFrame) -> DataFrame:
    """(eid, rev_eid): the least arc in the opposite direction, null if there is none."""
    back = arcs.groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.min("eid").alias("rev_eid"))
    return arcs.join(back, ["src", "dst"], "left").select("eid", "rev_eid")


def contract_round(edges: DataFrame) -> DataFrame:
    """One round of contraction: chains of degree-2 vertices become one edge if they hang between two different outside vertices. Edges (a < b)."""
    ends = edges.select(F.col("a").alias("vid"), F.col("b").alias("other")).union(edges.select("b", "a"))
    middle = written(ends.groupBy("vid").agg(F.count("*").alias("n")).filter("n = 2").select("vid"), "contract-middle")
    inner = edges.join(middle.withColumnRenamed("vid", "a"), "a", "left_semi").join(middle.withColumnRenamed("vid", "b"), "b", "left_semi")
    chains = components(inner) if not inner.isEmpty() else middle.select(F.col("vid").alias("node"), F.col("vid").alias("comp")).limit(0)
    of = middle.join(chains, middle["vid"] == chains["node"], "left").select("vid", F.coalesce("comp", "vid").alias("chain"))
    outside = ends.join(of, "vid").join(middle.withColumnRenamed("vid", "other"), "other", "left_anti")
    bridges = outside.groupBy("chain").agg(F.count("*").alias("n"), F.min("other").alias("a"), F.max("other").alias("b")).filter("n = 2 AND a < b").select("a", "b")
    rest = edges.join(middle.withColumnRenamed("vid", "a"), "a", "left_anti").join(middle.withColumnRenamed("vid", "b"), "b", "left_anti")
    return written(rest.select("a", "b").union(bridges).distinct(), "contract-edges")


def contract(edges: DataFrame) -> tuple[DataFrame, int]:
    """(edges, rounds) once no vertex of degree 2 is left."""
    rounds = 0
    while True:
        ends = edges.select(F.col("a").alias("vid")).union(edges.select("b"))
        if ends.groupBy("vid").count().filter("count = 2").isEmpty():
            return edges, rounds
        edges, rounds = contract_round(edges), rounds + 1


def labelled(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, comp): least vertex of each vertex's component, lone vertices included. Edges (src, dst)."""
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a != b")
    if links.isEmpty():
        return vertices.select("vid", F.col("vid").alias("comp"))
    found = components(links)
    return vertices.select("vid").join(found, vertices["vid"] == found["node"], "left").select("vid", F.coalesce("comp", "vid").alias("comp"))


#: Fronts that a distance table is made of before they are merged into one.
FRONTS = 12


def distances(arcs: DataFrame, sources: DataFrame, cost: str | None) -> DataFrame:
    """(unit, vid, dist): least cost from each unit's sources (unit, vid) along the arcs, hops if ``cost`` is None; unreached vertices are left out.

    Relaxation in rounds for all units at once, until nothing improves: only vertices that
    improved in the last round send to their neighbours, and a round writes only what it
    improved (the front), so vertices that are done are looked up but not written again;
    every FRONTS rounds the fronts are merged. Costs must not be negative. Arcs with a
    column ``unit`` serve that unit alone.
    """
    step = F.lit(1.0) if cost is None else F.col(cost)
    on = ["unit", "vid"] if "unit" in arcs.columns else ["vid"]
    out = arcs.select(*on[:-1], F.col("src").alias("vid"), "dst", step.alias("step"))
    front = written(sources.select("unit", "vid").distinct().withColumn("dist", F.lit(0.0)), "distances")
    fronts = [front]
    while True:
        known = reduce(DataFrame.unionByName, fronts)
        sent = front.join(out, on).select("unit", F.col("dst").alias("vid"), (F.col("dist") + F.col("step")).alias("dist")).groupBy("unit", "vid").agg(F.min("dist").alias("dist"))
        better = sent.join(known.withColumnRenamed("dist", "old"), ["unit", "vid"], "left")
        if cost is None:  # hops never improve on a vertex reached before
            better = sent.join(known, ["unit", "vid"], "left_anti")
        else:
            better = better.groupBy("unit", "vid").agg(F.min("dist").alias("dist"), F.min("old").alias("old")).filter("old IS NULL OR dist < old").select("unit", "vid", "dist")
        seen = Observation()
        front = written(better.observe(seen, F.count("*").alias("n")), "distances")
        if not seen.get["n"]:
            released(front)
            return _least(fronts, cost)
        fronts.append(front)
        if len(fronts) > FRONTS:
            merged = written(_least(fronts, cost), "distances")
            released(*fronts[:-1])
            fronts = [merged]


def _least(fronts: list[DataFrame], cost: str | None) -> DataFrame:
    rows = reduce(DataFrame.unionByName, fronts)
    return rows if cost is None else rows.groupBy("unit", "vid").agg(F.min("dist").alias("dist"))


def efficiency(arcs: DataFrame, sources: DataFrame, n_original: int, cost: str | None = None, both: bool = False, chunk: int = hops.CHUNK) -> DataFrame:
    """(unit, e): sum of 1/distance from a unit's sources to all others, over sources x (n - 1).

    ``sources``: (unit, source, alive). Removed sources count in the denominator only. Arcs
    with a column ``unit`` serve that unit's sources alone. ``both``: arcs are links, in hops and without units.
    """
    key = F.struct("unit", "source")
    if cost is None and "unit" not in arcs.columns:
        terms = _in_hops(arcs, written(sources.filter("alive").select("unit", "source").distinct(), "efficiency-live"), both, chunk)
    elif cost is None:
        terms = by_masks(arcs, sources.filter("alive").select("unit", "source"))
    else:
        live = sources.filter("alive").select(key.alias("unit"), F.col("source").alias("vid"))
        if "unit" in arcs.columns:  # arcs of a unit serve each of its sources
            arcs = arcs.join(sources.filter("alive").select("unit", "source"), "unit").withColumn("unit", key)
        terms = distances(arcs, live, cost).filter("dist > 0").groupBy(F.col("unit.unit").alias("unit")).agg(F.sum(1 / F.col("dist")).alias("total"))
    sizes = sources.groupBy("unit").agg(F.count("*").alias("k"))
    return sizes.join(terms, "unit", "left").select("unit", (F.coalesce("total", F.lit(0.0)) / (F.col("k") * F.lit(n_original - 1))).alias("e"))


def _in_hops(arcs: DataFrame, live: DataFrame, both: bool, chunk: int) -> DataFrame:
    """As of :func:`by_masks`: tasks search whole components (:mod:`egress.operators.hops`); a component that is too large for a task goes by joins."""
    units = written(ranked(live.select("unit").distinct(), "unit"), "efficiency-units")
    links, nodes = labelled_links(written(arcs.select("src", "dst"), "efficiency-edges"))
    links, places, far, left = hops.by_component(links, nodes, live.select(F.col("source").alias("vid")).distinct(), chunk)
    asked = places.join(live.withColumnRenamed("source", "vid"), "vid").join(F.broadcast(units), "unit").select("vid", "bin", F.col("rnk").alias("tag"))
    found = written(hops.pairs(links, asked, both=both).groupBy("unit", "hops").agg(F.sum("n").alias("n")), "efficiency-pairs")
    terms = found.groupBy(F.col("unit").alias("rnk")).agg(F.sum(F.col("n") / F.col("hops")).alias("total")).join(units, "rnk").select("unit", "total")
    if left:
        far = written(to_directed(far) if both else far, "efficiency-far")
        terms = terms.unionByName(by_masks(far, live)).groupBy("unit").agg(F.sum("total").alias("total"))
    return terms


#: Sources that share a row, a bit each.
BITS = 63


def by_masks(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(unit, total): sum of 1 / hops from a unit's sources (unit, source) to all others along the arcs. Arcs with a column ``unit`` serve that unit alone.

    Rounds as in :func:`distances`, but BITS sources of a unit share a vertex's row, and an arc sends one number for all of them.
    """
    on = ["unit", "vid"] if "unit" in arcs.columns else ["vid"]
    key, out = ["unit", "block", "vid"], arcs.select(*on[:-1], F.col("src").alias("vid"), "dst")
    placed = ranked(sources.select("unit", "source").distinct(), "unit", "source")
    start = placed.select("unit", F.floor(F.col("rnk") / BITS).alias("block"), F.col("source").alias("vid"), F.expr(f"shiftleft(1L, CAST(rnk % {BITS} AS INT))").alias("mask"))
    front, hops_, none = written(start.groupBy(*key).agg(F.bit_or("mask").alias("mask")), "masks"), 0, F.lit(0).cast("long")
    fronts, totals = [front], [sources.select("unit", F.lit(0.0).alias("total")).limit(0)]
    while True:
        hops_ += 1
        sent = front.join(out, on).select("unit", "block", F.col("dst").alias("vid"), F.col("mask").alias("got"), none.alias("seen"))
        known = reduce(DataFrame.unionByName, fronts).select(*key, none.alias("got"), F.col("mask").alias("seen"))
        both = sent.unionByName(known).groupBy(*key).agg(F.bit_or("got").alias("got"), F.bit_or("seen").alias("seen"))
        seen = Observation()
        new = both.select(*key, F.col("got").bitwiseAND(F.bitwise_not("seen")).alias("mask")).filter("mask != 0")
        front = written(new.observe(seen, F.count("*").alias("n")), "masks")
        if not seen.get["n"]:
            released(front, *fronts)
            return reduce(DataFrame.unionByName, totals).groupBy("unit").agg(F.sum("total").alias("total"))
        totals.append(written(front.groupBy("unit").agg((F.sum(F.bit_count("mask")) / hops_).alias("total")), "masks-totals"))
        fronts.append(front)
        if len(fronts) > FRONTS:
            merged = written(reduce(DataFrame.unionByName, fronts).groupBy(*key).agg(F.bit_or("mask").alias("mask")), "masks")
            released(*fronts[:-1])
            fronts = [merged]


def betweenness(edges: DataFrame, sources: DataFrame, n: int, chunk: int = hops.CHUNK) -> DataFrame:
    """(vid, load): shortest paths (hops) from sampled sources (vid) to all others that pass a vertex, scaled by n / sources.

    Tasks search whole components (:mod:`egress.operators.hops`); a component that is too large for a task goes by joins.
    """
    sources = written(sources.select("vid"), "load-sources")
    links, nodes = labelled_links(written(edges.select("src", "dst"), "load-edges"))
    links, places, far, left = hops.by_component(links, nodes, sources, chunk)
    found = written(links.groupBy("bin").cogroup(places.groupBy("bin")).applyInPandas(hops.loads, "vid long, load double"), "load-found")
    if left:
        far = written(far, "load-far")
        ends = far.select(F.col("src").alias("vid")).union(far.select("dst"))
        asked = written(sources.join(ends, "vid", "left_semi"), "load-asked")
        low, high = far.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        if left <= hops.FAR * chunk and high - low < 2 * hops.FAR * chunk:
            more = hops.loads_of_one(far, asked, low, high - low + 1, left, chunk).groupBy("vid").agg(F.sum("load").alias("load"))
        else:
            more = _loads_by_levels(far, asked)
        found = found.unionByName(written(more, "load-found"))
    return found.select("vid", (F.col("load") * F.lit(n / max(sources.count(), 1))).alias("load"))


def _loads_by_levels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(vid, load), not scaled: levels outwards count paths, levels inwards add up dependencies, for all sources at once."""
    both = written(to_directed(edges.select("src", "dst")), "load-arcs")
    levels = [written(sources.select(F.col("vid").alias("s"), "vid", F.lit(1.0).alias("paths")), "load-level")]
    while True:
        reached = levels[-1].join(both, F.col("vid") == F.col("src")).groupBy("s", F.col("dst").alias("vid")).agg(F.sum("paths").alias("paths"))
        for level in levels[-2:]:  # an undirected link leads one level up or down, or stays
            reached = reached.join(level.select("s", "vid"), ["s", "vid"], "left_anti")
        new = written(reached, "load-level")
        if new.isEmpty():
            released(new)
            break
        levels.append(new)
    done = [levels[-1].withColumn("dep", F.lit(0.0))]
    for level in reversed(levels[:-1]):
        lower = done[-1].select("s", F.col("vid").alias("child"), F.col("paths").alias("p"), "dep")
        given = lower.join(both, F.col("child") == F.col("src")).select("s", F.col("dst").alias("vid"), ((1 + F.col("dep")) / F.col("p")).alias("unit_dep")).groupBy("s", "vid").agg(F.sum("unit_dep").alias("unit_dep"))
        upper = level.join(given, ["s", "vid"], "left").select("s", "vid", "paths", (F.col("paths") * F.coalesce("unit_dep", F.lit(0.0))).alias("dep"))
        done.append(written(upper, "load-done"))
    return reduce(DataFrame.unionByName, done).filter("vid != s").groupBy("vid").agg(F.sum("dep").alias("load"))
