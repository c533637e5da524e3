"""Hand-solved networks, random networks against brute force, and registered queries against DuckDB."""

import heapq
import itertools
import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from egress.functions import geo, roads
from egress.functions.ranks import ranked
from egress.operators import communities, evacuation, flow, graph, hazard, hops, regions, removal, routing, spatial
from egress.operators.components import components, labelled_links
from egress.plans import queries
from egress.sources import roads as sources

ARCS = "unit string, eid long, src long, dst long, capacity_vph double, travel_s double, hazard_max int, length_m double"
#: Three origins (10 to 12), two junctions, two exits (30, 31); two of the ways out of the first junction are in hazard.
WEDGE = [
    ("w", 0, 10, 20, 60.0, 4.0, 0, 120.0),
    ("w", 1, 11, 20, 40.0, 3.0, 0, 90.0),
    ("w", 2, 12, 21, 50.0, 2.0, 0, 150.0),
    ("w", 3, 20, 30, 80.0, 5.0, 2, 200.0),
    ("w", 4, 21, 31, 35.0, 6.0, 0, 300.0),
    ("w", 5, 21, 20, 25.0, 2.0, 0, 80.0),
    ("w", 6, 20, 31, 20.0, 9.0, 3, 250.0),
]


def wedge(spark, arcs=WEDGE):
    side = lambda *vids: spark.createDataFrame([("w", v) for v in vids], "unit string, vid long")
    return spark.createDataFrame(arcs, ARCS), side(10, 11, 12), side(30, 31)


def test_accessibility_by_hand(spark):
    population = spark.createDataFrame([("w", 270)], "unit string, population long")
    row = flow.accessibility(*wedge(spark), threshold=3, population=population).first()
    assert (row.n_vertices, row.n_disjoint, row.capacity_vph, row.tt_min, row.cut_off, row.people_per_capacity) == (3, 3, 135.0, 8.0, False, 2.0)
    assert row.exposed_share == pytest.approx(20 / 135) and row.efficiency == pytest.approx((1 / 9 + 2 / 8) / 3)


def test_hazard_removal_and_cut_off(spark):
    row = flow.accessibility(*wedge(spark, [a for a in WEDGE if a[6] < 2]), threshold=3).first()
    assert (row.capacity_vph, row.n_disjoint) == (35.0, 1)
    row = flow.accessibility(*wedge(spark, [("w", 0, 10, 11, 1.0, 1.0, 0, 1.0)]), threshold=3).first()
    assert (row.cut_off, row.efficiency, row.capacity_vph, row.tt_min) == (True, 0.0, 0.0, float("inf"))


def test_members_that_are_targets(spark):
    arcs, members, _ = wedge(spark)
    row = flow.accessibility(arcs, members, members, threshold=3).first()
    assert row.n_vertices == 0 and row.capacity_vph is None


def test_managed_by_hand(spark):
    arcs, members, targets = wedge(spark)
    out, binding = flow.managed(arcs, members.withColumn("w", F.lit(1.0)), targets)
    assert out.first().managed_vph == pytest.approx(120)
    assert {r.eid for r in binding.collect()} == {1}
    upper = spark.createDataFrame([("w", 135.0)], "unit string, upper double")
    assert flow.managed(arcs, members.withColumn("w", F.lit(1.0)), targets, 128, upper)[0].first().managed_vph == pytest.approx(135 * 113 / 128)


def test_managed_with_an_origin_on_a_target(spark):
    """Its share arrives at once, and counts; the bound holds the total."""
    arcs = spark.createDataFrame([("c", 0, 0, 9, 30.0, 1.0, 0, 1.0), ("c", 1, 1, 9, 80.0, 1.0, 0, 1.0)], ARCS)
    weights = spark.createDataFrame([("c", 0, 0.5), ("c", 1, 0.1), ("c", 9, 0.4)], "unit string, vid long, w double")
    targets = spark.createDataFrame([("c", 9)], "unit string, vid long")
    for bound, want in ((110.0, 60.0), (45.0, 45.0)):
        upper = spark.createDataFrame([("c", bound)], "unit string, upper double")
        assert flow.managed(arcs, weights, targets, upper=upper)[0].first().managed_vph == pytest.approx(want)
    roads_ = arcs.select("unit", "eid", "src", "dst", F.col("capacity_vph").alias("cap"), F.col("travel_s").alias("t0"))
    row = evacuation.settle(roads_, weights, targets, spark.createDataFrame([("c", 50.0)], "unit string, d double")).first()
    assert (row.unreachable, row.delivered, row.converged) == (0.0, pytest.approx(30.0), True)


def test_plan_conserves_flow(spark):
    more = [*WEDGE, ("w", 7, 21, 20, 10.0, 1.0, 0, 100.0)]
    arcs, members, targets = wedge(spark, more)
    demand = spark.createDataFrame([("w", 120.0)], "unit string, d double")
    plan = {r.eid: r.flow for r in flow.managed_flow(arcs, members.withColumn("w", F.lit(1.0)), targets, demand).collect()}
    net = Counter()
    for _, eid, src, dst, cap, *_ in more:
        assert 0 <= plan[eid] <= cap
        net[src] -= plan[eid]
        net[dst] += plan[eid]
    assert {v: round(x, 6) for v, x in net.items() if v < 20} == {10: -40.0, 11: -40.0, 12: -40.0}
    assert net[30] + net[31] == pytest.approx(120) and abs(net[20]) + abs(net[21]) < 1e-9


def plain_settle(arcs, weights, targets, demand, most=60):
    """(delivered, ratio, unreachable, rounds, converged) of arcs (eid, src, dst, cap, t0), origin by origin."""
    times, seen, told = {a[0]: a[4] for a in arcs}, {}, []
    into, out = defaultdict(list), defaultdict(list)
    for a in arcs:
        into[a[2]].append(a), out[a[1]].append(a)
    for k in range(1, most + 1):
        dist, heap, done = {v: 0.0 for v in targets}, [(0.0, v) for v in targets], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v not in done:
                done.add(v)
                for e, src, *_ in into[v]:
                    if d + times[e] < dist.get(src, math.inf):
                        dist[src] = d + times[e]
                        heapq.heappush(heap, (dist[src], src))
        ways = {}
        for o in weights:
            way, v = [], o
            while v not in targets and v in dist:
                way.append(min((times[a[0]] + dist[a[2]], a[0], a[2]) for a in out[v] if a[2] in dist)[1:])
                v = way[-1][1]
            ways[o] = [e for e, _ in way]
        load = Counter()
        for o, way in ways.items():
            load.update({e: weights[o] * demand for e in way})
        cap = {a[0]: a[3] for a in arcs}
        delivered = sum(weights[o] * demand * min(1.0, *(cap[e] / load[e] for e in way)) for o, way in ways.items() if way)
        told.append((delivered, max([0.0, *(x / cap[e] for e, x in load.items())])))
        key = tuple(sorted((o, tuple(way)) for o, way in ways.items()))
        if key in seen or k == most:
            cycle = told[seen.get(key, k - 1) :]
            return sum(d for d, _ in cycle) / len(cycle), max(r for _, r in cycle), sum(w for o, w in weights.items() if o not in dist), k, seen.get(key) == k - 1
        seen[key] = k
        times = {a[0]: a[4] * load[a[0]] / a[3] if load[a[0]] > a[3] else a[4] for a in arcs}


def test_self_routed_by_hand(spark):
    """From 105 on the short way out of the third origin jams."""
    arcs, members, targets = wedge(spark)
    roads_ = arcs.select("unit", "eid", "src", "dst", F.col("capacity_vph").alias("cap"), F.col("travel_s").alias("t0"))
    managed = spark.createDataFrame([("w", 120.0)], "unit string, managed_vph double")
    row = evacuation.selfish(roads_, members.withColumn("w", F.lit(1 / 3)), targets, managed).first()
    plain = [plain_settle([(a[1], a[2], a[3], a[4], a[5]) for a in WEDGE], dict.fromkeys((10, 11, 12), 1 / 3), {30, 31}, 120 * f)[0] for f in evacuation.SCAN]
    assert row.strict_vph == pytest.approx(105) and row.rationed_vph == pytest.approx(max(105, *plain)) and max(plain) > 105


@pytest.mark.parametrize("most", [9, 1 << 15])
def test_settling_of_jammed_grids(spark, most):
    """Grids in which ways change and come back, in one region and in several, against plain Python; also measured in rounds."""
    arcs, weights, targets, demand, want, wide = [], [], [], [], {}, 6
    for u in range(7):
        rnd = random.Random(u)
        own = [(a, b) for v in range(wide * wide) for x in (v + 1, v + wide) if x < wide * wide and (x != v + 1 or x % wide) for a, b in ((v, x), (x, v)) if rnd.random() < 0.85]
        own = [(k, a, b, float(rnd.randint(2, 12)), float(rnd.randint(1, 6))) for k, (a, b) in enumerate(own)]
        raw = {v: rnd.randint(1, 4) for v in rnd.sample(range(wide * wide), 5)}
        shares, goals, d = {v: x / sum(raw.values()) for v, x in raw.items()}, set(rnd.sample(range(wide * wide), 2)), float(rnd.choice([5, 15, 30, 60]))
        arcs += [(str(u), *a) for a in own]
        weights += [(str(u), v, x) for v, x in shares.items()]
        targets += [(str(u), v) for v in goals]
        demand.append((str(u), d))
        want[str(u)] = plain_settle(own, shares, goals, d)
    where = regions.by_order(spark.range(wide * wide).withColumnRenamed("id", "vid"), most=most)
    tables = [spark.createDataFrame(r, "unit string, " + c) for r, c in ((arcs, "eid long, src long, dst long, cap double, t0 double"), (weights, "vid long, w double"), (targets, "vid long"), (demand, "d double"))]
    got = {r.unit: (r.delivered, r.ratio, r.unreachable, r.rounds, r.converged) for r in routing.settle(*tables, regions=where).collect()}
    assert got == {u: pytest.approx(x) for u, x in want.items()} and any(x[1] > 1 and not x[4] for x in want.values())


@pytest.mark.parametrize("most", [10, 40])
def test_flows_and_distances_over_regions(spark, most):
    """Flows, cuts and times that cross several regions: bounded and unbounded supply, against augmenting paths and rounds of joins."""
    wide, arcs, supply, targets, want = 8, [], [], [], {}
    for u in range(6):
        rnd = random.Random(u)
        own = [(a, b, float(rnd.randint(0, 9))) for v in range(wide * wide) for x in (v + 1, v + wide) if x < wide * wide and (x != v + 1 or x % wide) for a, b in ((v, x), (x, v)) if rnd.random() < 0.9]
        some = rnd.sample(range(wide * wide), 8)
        amounts = {v: flow.BIG if u % 2 else float(rnd.randint(1, 9)) for v in some[:5]}
        arcs += [(str(u), *a) for a in own]
        supply += [(str(u), v, x) for v, x in amounts.items()]
        targets += [(str(u), v) for v in some[5:]]
        want[str(u)] = plain_flow([*own, *((99, v, x) for v, x in amounts.items())], {99}, set(some[5:]))
    streets, held, goals = (spark.createDataFrame(r, c) for r, c in ((arcs, "unit string, src long, dst long, cap double"), (supply, "unit string, vid long, amount double"), (targets, "unit string, vid long")))
    where = regions.by_order(spark.range(wide * wide).withColumnRenamed("id", "vid"), most=most)
    got, reach, residual = regions.max_flow(streets, held, goals, where)
    assert {r.unit: r.flow for r in got.collect()} == want and residual.filter("cap < 0").isEmpty()
    cut = flow.cut_arcs(streets, reach).groupBy("unit").agg(F.sum("cap").alias("v")).collect()
    assert {r.unit: r.v for r in cut if int(r.unit) % 2} == {u: x for u, x in want.items() if int(u) % 2 and x}
    timed = streets.withColumn("t", F.col("cap") + 1)
    told = lambda df: {(r.unit, r.vid): r.dist for r in df.collect()}
    assert told(regions.distances(timed, goals, "t", where)) == told(graph.distances(timed, goals, "t"))


def test_regions_of_places(spark):
    rnd = random.Random(1)
    points = [(k, rnd.random() * 9, rnd.random() * 4) for k in range(64)] + [(70, None, None)]
    got = {r.vid: r.region for r in regions.by_place(spark.createDataFrame(points, "vid long, x double, y double"), 16).collect()}
    assert len(got) == 65 and max(Counter(got.values()).values()) == 16 and got[70] == 0


def test_random_flows_equal_least_cuts(spark):
    """Max-flow and managed demand of random networks are the least over all cuts."""
    rnd, arcs, members, want, demand = random.Random(8), [], [], {}, {}
    for u in range(6):
        n = rnd.randint(4, 7)
        own = [(str(u), k, *rnd.sample(range(n), 2), float(rnd.randint(1, 9)), 1.0, 0, 1.0) for k in range(rnd.randint(5, 14))]
        weights = {0: 1.0, 1: 2.0}
        arcs += own
        members += [(str(u), v, w) for v, w in weights.items()]
        cuts = [set(s) for k in range(n) for s in itertools.combinations(range(n - 1), k)]
        through = lambda s, own=own: sum(a[4] for a in own if a[2] in s and a[3] not in s)
        want[str(u)] = min(through(s) for s in cuts if {0, 1} <= s)
        demand[str(u)] = min(through(s) / (sum(w for v, w in weights.items() if v in s) / 3) for s in cuts if s & {0, 1})
        arcs.append((str(u), 99, n - 1, 1000, 1e6, 1.0, 0, 1.0))
    table = spark.createDataFrame(arcs, ARCS)
    own = spark.createDataFrame(members, "unit string, vid long, w double")
    targets = own.select("unit").distinct().withColumn("vid", F.lit(1000).cast("long"))
    got, reach, residual = flow.max_flow(table.withColumnRenamed("capacity_vph", "cap"), own.select("unit", "vid", F.lit(flow.BIG).alias("amount")), targets)
    assert {r.unit: r.flow for r in got.collect()} == pytest.approx(want)
    assert residual.filter("cap < 0").isEmpty()
    cut = flow.cut_arcs(table.withColumnRenamed("capacity_vph", "cap"), reach).groupBy("unit").agg(F.sum("cap").alias("v"))
    assert {r.unit: r.v for r in cut.collect()} == pytest.approx({u: v for u, v in want.items() if v})
    assert {r.unit: r.managed_vph for r in flow.managed(table, own, targets)[0].collect()} == pytest.approx(demand)
    parted = regions.by_order(spark.createDataFrame([(v,) for v in [*range(8), 1000]], "vid long"), most=6)
    assert {r.unit: r.managed_vph for r in flow.managed(table, own, targets, regions=parted)[0].collect()} == pytest.approx(demand)


def test_efficiency_of_a_path(spark):
    arcs = graph.to_directed(spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long"))
    sources_ = spark.createDataFrame([("a", 0, True), ("a", 1, True), ("b", 3, True), ("b", 9, False)], "unit string, source long, alive boolean")
    assert {r.unit: r.e for r in graph.efficiency(arcs, sources_, 4).collect()} == pytest.approx({"a": (11 / 6 + 2.5) / 6, "b": 11 / 6 / 6})


def test_removal_of_a_star(spark):
    nodes = spark.range(8).withColumnRenamed("id", "vid")
    edges = spark.createDataFrame([(0, k) for k in range(1, 8)], "src long, dst long")
    ranking = nodes.withColumn("rnk", F.col("vid") + 1)
    out = removal.removal_curve(nodes, edges, ranking, [0, 125, 1000]).orderBy("permille").collect()
    assert [(r.n_removed, r.s1, r.s2) for r in out] == [(0, 1.0, 0.0), (1, 0.125, 0.125), (8, 0.0, 0.0)]
    by_edge = removal.removal_curve(nodes, edges, edges.withColumn("rnk", F.col("dst")), [0, 500], "edge").orderBy("permille").collect()
    assert [(r.n_removed, r.s1) for r in by_edge] == [(0, 1.0), (4, 0.5)]
    alone = removal.removal_curve(nodes, edges.limit(0), ranking, [0, 875]).orderBy("permille").collect()
    assert [(r.s1, r.s2) for r in alone] == [(0.125, 0.125), (0.125, 0.0)]


@pytest.mark.parametrize("chunk", [1 << 20, 60, 8])
def test_removal_of_random_graphs(spark, chunk):
    """Several orders at once, as one pass, by forests of parts, and band by band."""
    rnd = random.Random(4)
    nodes, edges = list(range(-30, 60)), sorted({tuple(sorted(rnd.sample(range(-30, 60), 2))) for _ in range(130)})
    orders = {f"o{k}": rnd.sample(nodes, len(nodes)) for k in range(3)}
    by_edge = {f"e{k}": rnd.sample(edges, len(edges)) for k in range(2)}
    permille = [0, 50, 130, 400, 777, 1000]

    def sizes(alive, links):
        comp = {v: v for v in alive}
        for a, b in links:
            x, y = sorted((comp[a], comp[b]))
            comp = {v: x if c == y else c for v, c in comp.items()}
        return (sorted(Counter(comp.values()).values(), reverse=True) + [0, 0])[:2]

    table, links = spark.createDataFrame([(v,) for v in nodes], "vid long"), spark.createDataFrame(edges, "src long, dst long")
    ranks = spark.createDataFrame([(o, v, k + 1) for o, vs in orders.items() for k, v in enumerate(vs)], "order_name string, vid long, rnk long")
    left = {(o, f): set(vs[round(f * 90 / 1000) :]) for o, vs in orders.items() for f in permille}
    want = {(o, f): [90 - len(own), *(s / 90 for s in sizes(own, [e for e in edges if own.issuperset(e)]))] for (o, f), own in left.items()}
    assert {(r.order_name, r.permille): [r.n_removed, r.s1, r.s2] for r in removal.removal_curves(table, links, ranks, permille, chunk=chunk).collect()} == want
    ranks = spark.createDataFrame([(o, *e, k + 1) for o, es in by_edge.items() for k, e in enumerate(es)], "order_name string, src long, dst long, rnk long")
    want = {(o, f): [round(f * len(es) / 1000), *(s / 90 for s in sizes(nodes, es[round(f * len(es) / 1000) :]))] for o, es in by_edge.items() for f in permille}
    assert {(r.order_name, r.permille): [r.n_removed, r.s1, r.s2] for r in removal.removal_curves(table, links, ranks, permille, "edge", chunk=chunk).collect()} == want


def test_removal_by_components(spark, monkeypatch):
    """Many networks that fit one task each need neither forests of parts nor bands, and tell what one task for all tells."""
    rnd = random.Random(6)
    edges = [(100 * k + a, 100 * k + b) for k in range(6) for a, b in sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(42)})]
    nodes = list(range(600))
    table, links = spark.createDataFrame([(v,) for v in nodes], "vid long"), spark.createDataFrame(edges, "src long, dst long")
    ranks = spark.createDataFrame([(f"o{o}", v, k + 1) for o in range(2) for k, v in enumerate(rnd.sample(nodes, 600))], "order_name string, vid long, rnk long")
    by_edge = spark.createDataFrame([("e", *e, k + 1) for k, e in enumerate(rnd.sample(edges, len(edges)))], "order_name string, src long, dst long, rnk long")
    run = lambda chunk: [sorted(map(tuple, removal.removal_curves(table, links, r, [0, 100, 300, 1000], kind, chunk=chunk).collect())) for r, kind in ((ranks, "node"), (by_edge, "edge"))]
    want = run(1 << 20)
    monkeypatch.setattr(removal, "_by_bands", None)
    monkeypatch.setattr(removal, "_forest", None)
    assert run(30) == want


@pytest.mark.parametrize("way", ["packed", "bands", "far ids"])
def test_curves_without_ranks(spark, monkeypatch, way):
    """Orders by keys with ties tell what their ranks tell, without ranking all vertices; so do bands, and ids that are far between."""
    rnd = random.Random(11)
    vids = [k * (10**12 if way == "far ids" else 1) for k in range(-40, 120)]
    edges = sorted({tuple(sorted(rnd.sample(vids, 2))) for _ in range(200)})
    hot = {v: rnd.choice([-(5 << 31), -(1 << 31) - 3, 7, 7, 8, 2**31 + 40_000]) for v in vids}
    table, links = spark.createDataFrame([(v, hot[v], rnd.randrange(4)) for v in vids], "vid long, hot long, few long").cache(), spark.createDataFrame(edges, "src long, dst long").cache()
    few = {r.vid: r.few for r in table.collect()}
    ranks = [(o, v, k + 1) for o, key in (("a", hot), ("b", few)) for k, v in enumerate(sorted(vids, key=lambda v: (key[v], v)))]
    permille = [0, 60, 110, 111, 350, 500, 1000]
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = plain(removal.removal_curves(table, links, spark.createDataFrame(ranks, "order_name string, vid long, rnk long"), permille))
    of_edges = [("e", *e, k + 1) for k, e in enumerate(sorted(edges, key=lambda e: ((e[0] + e[1]) % 5, e)))]
    want_edges = plain(removal.removal_curves(table, links, spark.createDataFrame(of_edges, "order_name string, src long, dst long, rnk long"), permille, "edge"))
    monkeypatch.setattr(removal, "WHOLE", 0 if way == "bands" else 128)
    if way == "packed":
        monkeypatch.setattr(removal, "ranked", None)
        monkeypatch.setattr(removal, "labelled_links", None)
    assert plain(removal.curves_by_keys(table, links, {"a": F.col("hot"), "b": F.col("few")}, permille, chunk=20)) == want
    assert plain(removal.curves_by_keys(table, links, {"e": F.pmod(F.col("src") + F.col("dst"), F.lit(5))}, permille, "edge", chunk=20)) == want_edges


def test_sets_joined_as_arrays():
    """Links joined as arrays come to the sets and sizes of links joined one by one."""
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 20), (400, 300), (400, 2000)):
        a, b = rng.integers(0, n, (2, m)).astype(np.int32)
        parent, size = np.arange(n, dtype=np.int32), np.ones(n, np.int32)
        for k in range(0, m, 130):
            removal.join_all(parent, size, a[k : k + 130], b[k : k + 130])
        sets = removal._Sets()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            sets.join(x, y)
        assert sorted(size[size > 1].tolist()) == sorted(s for s in sets.size.values() if s > 1) and size.sum() == n
        assert removal._two(size) == sets.largest()


def test_random_orders_differ(spark):
    """Two seeds give different orders, and ids below zero are drawn as others are."""
    nodes = spark.range(-400, 400).withColumnRenamed("id", "vid")
    rows = removal.random_orders(nodes, [1, 2]).collect()
    one, two = ({r.vid: r.rnk for r in rows if r.order_name == f"random{k}"} for k in (1, 2))
    assert sorted(one.values()) == sorted(two.values()) == list(range(1, 801)) and sum(one[v] == two[v] for v in one) < 20
    assert sum(abs(one[v] - two[v]) for v in one) / 800 > 200
    for order in (one, two):
        assert 120 < sum(order[v] <= 400 for v in order if v < 0) < 280


def test_edge_list_and_dimacs(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# links\n7\t4\n4 7\n\n4\t15\n15\t15\n")
    vertices, edges = sources.load_roads(spark, "edgelist", path=f"file://{tmp_path}/e.txt")
    assert sorted(map(tuple, vertices.collect())) == [(0, 4), (1, 7), (2, 15)]
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (0, 2)]
    (tmp_path / "g.gr").write_text("c x\np sp 3 4\na 1 2 7\na 2 1 5\na 2 2 1\na 3 1 4\n")
    (tmp_path / "g.co").write_text("v 1 1000000 2000000\nv 3 -500000 0\n")
    vertices, arcs = sources.load_roads(spark, "dimacs", gr=f"file://{tmp_path}/g.gr", co=f"file://{tmp_path}/g.co")
    assert sorted(map(tuple, arcs.collect())) == [(0, 1, 5.0), (0, 2, 4.0)]
    assert [tuple(r) for r in vertices.orderBy("vid").collect()] == [(0, 1.0, 2.0), (1, None, None), (2, -0.5, 0.0)]
    with pytest.raises(ValueError, match="unknown"):
        sources.load_roads(spark, "nothing")


def test_overlay_of_a_rectangle(spark):
    segments = spark.createDataFrame([(0, 2.0, 5.0, 22.0, 5.0), (1, 2.0, 90.0, 12.0, 90.0), (2, 3.0, 5.0, 3.0, 5.0)], "eid long, x0 double, y0 double, x1 double, y1 double")
    zone = spark.range(1).select(F.lit(1).alias("pid"), F.lit(3).alias("level"), geo.ring((0, 3), (7, 3), (7, 8), (0, 8)).alias("ring"))
    out = hazard.shares_wide(segments, hazard.overlay_polygons(segments, zone, 2.0), [1, 2, 3]).orderBy("eid").collect()
    assert [r.hazard_max for r in out] == [3, 0, 0] and out[0].hazard_share_3 == pytest.approx(0.25)


def test_contraflow_and_widening(spark):
    back = ("w", 8, 30, 20, 35.0, 5.0, 0, 210.0)
    arcs = wedge(spark, [*WEDGE, back])[0]
    chosen = lambda *eids: spark.createDataFrame([("w", e) for e in eids], "unit string, eid long")
    caps = lambda df: {r.eid: r.capacity_vph for r in df.collect()}
    out, metres = evacuation.contraflow(arcs, chosen(3))
    assert (caps(out)[3], caps(out)[8], metres.first().metres) == (115.0, 0.0, 200.0)
    assert caps(evacuation.widen(arcs, 1, 50.0))[1] == 90.0
    both, metres = evacuation.contraflow(arcs, chosen(3, 8))  # the later arc takes all back
    assert (caps(both)[3], caps(both)[8], metres.first().metres) == (0.0, 115.0, 410.0)
    twin = wedge(spark, [*WEDGE, back, ("w", 9, 20, 30, 11.0, 1.0, 0, 70.0)])[0]
    out, metres = evacuation.contraflow(twin, chosen(3, 9, 0))  # one taker for one reverse arc; arc 0 has none
    assert (caps(out)[3], caps(out)[9], caps(out)[8], caps(out)[0], metres.first().metres) == (115.0, 11.0, 0.0, 60.0, 200.0)


def test_contraction(spark):
    """Two hubs joined by three ways, with a loop, a ring of its own and loose ends: what the first round leaves is a chain again."""
    ways = [(1, 2), (1, 10), (10, 11), (11, 2), (1, 20), (20, 2), (1, 30), (2, 31), (31, 40), (40, 41), (31, 41), (50, 51), (51, 52), (50, 52)]
    edges = spark.createDataFrame(ways, "a long, b long")
    assert {tuple(r) for r in graph.contract_round(edges).collect()} == {(1, 2), (1, 30), (2, 31)}
    out, rounds = graph.contract(edges)
    assert {tuple(r) for r in out.collect()} == {(30, 31)} and rounds == 2


def test_components_of_random_links(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(400, 480)]
    comp = {}
    for a, b in links:
        if a != b:
            x, y = comp.setdefault(a, a), comp.setdefault(b, b)
            comp = {n: min(x, y) if c in (x, y) else c for n, c in comp.items()}
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r.node: r.comp for r in got.collect()} == comp
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_points_and_borders(spark):
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.0, 0.5), (2, 1.5, 0.5), (3, 0.0, 0.0)], "pid long, x double, y double")
    square = spark.range(1).select(F.lit("s").alias("name"), geo.ring((0, 0), (1, 0), (1, 1), (0, 1)).alias("ring"))
    assert [r.pid for r in spatial.points_in(points, square, 0.3).collect()] == [0]
    assert sorted(r.pid for r in spatial.points_in(points, square, 0.3, "left_semi", strict=False).collect()) == [0, 1, 3]
    assert spatial.points_in(points, square, 0.3, "left").count() == 4
    x, y = geo.albers(F.lit(-120.0), F.lit(37.25))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), geo.area(geo.ring((0, 0), (2, 0), (0, 2))).alias("a"), geo.length(geo.ring((0, 0), (3, 4), (3, 5))).alias("l")).first()
    assert abs(row.x) < 1e-6 and abs(row.y) < 120_000 and (row.a, row.l) == (2.0, 6.0)


def test_nearest_ties(spark):
    q = spark.createDataFrame([("g", 1, 0.0, 0.0)], "grp string, qid long, x double, y double")
    s = spark.createDataFrame([("g", 7, 1.0, 0.0), ("g", 8, -1.0, 0.0), ("h", 9, 0.0, 0.0)], "grp string, sid long, x double, y double")
    assert [r.sid for r in spatial.nearest(q, s, ["grp"]).collect()] == [7]
    assert sorted(r.sid for r in spatial.nearest(q, s, ["grp"], "all").collect()) == [7, 8]


def test_ranks_and_labels(spark):
    values = [5, 1, 9, 1, 7]
    out = ranked(spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, k long"), "v", "k").orderBy("rnk").collect()
    assert [(r.rnk, r.v) for r in out] == list(enumerate(sorted(values)))
    clashing = spark.createDataFrame([(3, "a", 1, 9), (1, "b", 2, 8)], "v long, id string, part int, shift int")
    assert [tuple(r) for r in ranked(clashing, "v").orderBy("rnk").collect()] == [(1, "b", 2, 8, 0), (3, "a", 1, 9, 1)]
    clock = lambda h: roads.clock(F.lit(h))
    row = spark.range(1).select(clock(25.5), clock(0.375), clock(0.125), roads.lanes(F.lit("3;2.5")), roads.lanes(F.lit("x")), roads.plain_place(F.lit("Springfield town, Somewhere"))).first()
    assert tuple(row) == ("25:30", "00:22", "00:08", 2.5, None, "Springfield")


def test_tag_rules(spark):
    """No highway tag, no road; areas are searched for; some tracks are excluded."""
    rows = [(None, None, None), ("primary", None, None), ("track", "yes;no", None), ("track", None, "grade5"), ("track", None, "grade1")]
    tags = {c: F.col(c) for c in ("highway", "area", "tracktype")}
    got = spark.createDataFrame(rows, "highway string, area string, tracktype string").select(roads.drivable(tags), roads.extra_road(tags, ["track"], [], ["grade5"])).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, False), (False, False), (False, False), (False, True)]


def test_small_steps(spark):
    row = spark.range(1).select(roads.first_of(F.array(F.lit("primary"), F.lit("track"))).alias("a"), roads.first_of(F.array().cast("array<string>")).alias("b"), roads.lanes_of_list(F.array(F.lit("4"), F.lit("3;2"))).alias("c")).first()
    assert tuple(row) == ("primary", None, 2.0)
    groups = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("i", "z")], "group string, name string")
    assert sorted(r.group for r in communities.complete(groups, spark.createDataFrame([("a",)], "name string")).collect()) == ["h"]
    assert communities.without_prefix(spark.createDataFrame([(1, 2, 3)], "unit int, I4_a int, I3_b int"), "I4_").columns == ["unit", "I3_b"]
    classes, default = sources.class_table(spark, {"motorway": [2000, 3], "default": [500, 1]})
    assert [tuple(r) for r in classes.collect()] == [("motorway", 3.0, 2000.0)] and default == (1.0, 500.0)
    arcs = spark.createDataFrame([(0, 0.0, 0.0, 2.0, 0.0), (1, 30.0, 0.0, 31.0, 0.0)], "eid long, x0 double, y0 double, x1 double, y1 double")
    towns = spark.range(1).select(F.lit("c").alias("unit"), geo.ring((-2, -2), (0, -2), (0, 2), (-2, 2)).alias("ring"))
    assert [tuple(r) for r in communities.near_arcs(arcs, towns, 5.0, 4.0).collect()] == [("c", 0)]


def test_settings(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("capacity:\n  primary: [900, 2]\n  default: [500, 1]\n")
    assert sources.read_config(str(tmp_path / "c.yaml"))["capacity"]["primary"] == [900, 2]


def test_clearance_by_hand(spark):
    row = evacuation.clearance(spark.createDataFrame([(600.0, 200.0, 300.0, 100.0)], "vehicles double, managed_vph double, rationed_vph double, strict_vph double")).first()
    assert (row.managed_h, row.bulk_h, row.last_h, row.gap_bulk, row.gap_last) == (3.0, 2.0, 6.0, 0.0, 0.5)


SF = "/root/testdata/sf0.001"


#: Minutes together; tests by hand hold what they call.
SLOW = {"policy_table", "widen_choice", "retro_cut"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - SLOW))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    key = lambda r: [(v is None, str(v)) for v in r]
    order = sorted(names)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=key)
    assert rows == expected


class Whole:
    """The links of all line items, and brute force over them."""

    def __init__(self):
        rows = duckdb.sql(f"SELECT l_orderkey, -1 - l_partkey FROM '{SF}/lineitem.parquet'").fetchall()
        self.edges = sorted({(min(r), max(r)) for r in rows if r[0] != r[1]})
        self.nodes = sorted({v for e in self.edges for v in e})

    def comp(self, nodes, edges):
        parent = {v: v for v in nodes}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        return {v: root(v) for v in nodes}

    def sizes(self, nodes, edges):
        found = sorted(Counter(self.comp(nodes, edges).values()).values(), reverse=True)
        return (found + [0, 0])[:2]

    def tie(self, v, seed):
        return pow((v % 2147483647 * 48271 + seed * 69621 + 1) % 2147483647, 5, 2147483647)

    def curve(self, element, seed=1):
        order = sorted(self.nodes, key=lambda v: (self.tie(v, seed), v)) if element == "node" else sorted(self.edges, key=lambda e: (self.tie(abs(e[0]) * 7919 + abs(e[1]), seed), e))
        out = []
        for f in queries.PERMILLE:
            cut = round(f * len(order) / 1000)
            left = set(order[cut:])
            nodes, edges = (left, [e for e in self.edges if left.issuperset(e)]) if element == "node" else (self.nodes, left)
            out.append((f, cut, *(round(s / len(self.nodes), 6) for s in self.sizes(nodes, edges))))
        return out

    def loads(self):
        around = defaultdict(list)
        for a, b in self.edges:
            around[a].append(b), around[b].append(a)
        sources_, load = sorted(self.nodes, key=lambda v: (self.tie(v, 99), v))[: queries.SAMPLE], Counter()
        for s in sources_:
            depth, paths, order = {s: 0}, Counter({s: 1}), [s]
            for v in order:
                for w in around[v]:
                    if w not in depth:
                        depth[w] = depth[v] + 1
                        order.append(w)
                    if depth[w] == depth[v] + 1:
                        paths[w] += paths[v]
            dep = Counter()
            for w in reversed(order[1:]):
                load[w] += dep[w]
                for v in around[w]:
                    if depth[v] == depth[w] - 1:
                        dep[v] += paths[v] / paths[w] * (1 + dep[w])
        return sorted((v * len(self.nodes) / len(sources_) for v in load.values()), reverse=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_graph_of_all_line_items(spark):
    """Every line item is a link: one large component, against brute force."""
    whole, rows = Whole(), lambda name: [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]
    want = whole.comp(whole.nodes, whole.edges)
    assert dict(rows("components")) == want and max(Counter(want.values()).values()) > len(want) / 2
    assert rows("component_sizes") == [tuple(whole.sizes(whole.nodes, whole.edges))]
    assert len(rows("edgelist_dedup")) == len(whole.edges)
    told = queries.QUERIES["removal_experiment"](spark, SF).collect()
    curve = lambda name: sorted((r.permille, r.n_removed, r.s1, r.s2) for r in told if r.order_name == name)
    assert curve("edges") == whole.curve("edge") and curve("random3") == whole.curve("node", 3) != curve("random4")
    assert len(told) == 13 * 33
    assert [r.load for r in queries.QUERIES["top_betweenness"](spark, SF).orderBy("rnk").collect()] == pytest.approx(whole.loads()[: len(whole.nodes) // 100])


def test_loads_by_component(spark, monkeypatch):
    """Whole components go to tasks, so tables don't grow with levels; components too large for a task go by levels, to the same loads."""
    path = [(k, k + 1) for k in range(1, 60)]
    ring = [(100, 101), (101, 102), (102, 103), (100, 103), (101, 104)]
    edges = spark.createDataFrame(path + ring + [(200, 201)], "src long, dst long")
    sources_, tables, plain = spark.createDataFrame([(1,), (30,), (100,)], "vid long"), [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name, **o: (tables.append(name), plain(df, name, **o))[1])
    want = {v: 59.0 if v < 30 else 2.0 * (60 - v) for v in range(2, 61)} | {1: 0.0, 30: 30.0}
    want |= {101: 1.5, 102: 0.0, 103: 0.5, 104: 0.0}
    loads = lambda **o: {r.vid: r.load for r in graph.betweenness(edges, sources_, 3, **o).collect()}
    assert loads() == pytest.approx(want) and len(tables) < 10
    assert loads(chunk=1) == pytest.approx(want)


@pytest.mark.parametrize("way", ["arrays", "levels"])
def test_loads_of_a_large_component(spark, monkeypatch, way):
    """A component that is too large to be dealt out is laid out in parts for some sources at a time, or goes by levels, to the same loads."""
    rng = random.Random(8)
    links = sorted({tuple(sorted(rng.sample(range(-30, 40), 2))) for _ in range(150)})
    edges, asked = spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(v,) for v in sorted({a for a, _ in links})[::3]], "vid long")
    want = {r.vid: r.load for r in graph.betweenness(edges, asked, 70).collect()}
    monkeypatch.setattr(hops, "FAR", 1 << 10 if way == "arrays" else 0)
    monkeypatch.setattr(hops, "STEP", 7)
    if way == "arrays":
        monkeypatch.setattr(graph, "_loads_by_levels", None)
    told = {r.vid: r.load for r in graph.betweenness(edges, asked, 70, chunk=5).collect()}
    assert told == pytest.approx(want) and len(asked.collect()) > hops.AT_ONCE


def test_efficiency_curve_by_component(spark, monkeypatch):
    """All sources of a component are searched at once, by tasks or by masks of sources; arcs are never multiplied by sources."""
    rng = random.Random(5)
    links = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)} | {(100 + k, 101 + k) for k in range(20)})
    vids = sorted({v for e in links for v in e})
    rank = {v: k + 1 for k, v in enumerate(rng.sample(vids, len(vids)))}
    asked, want = vids[::3], {}
    for f in (0, 100, 400):
        left = {v for v in vids if rank[v] > round(f * len(vids) / 1000)}
        total = 0.0
        for s in left.intersection(asked):
            depth, order = {s: 0}, [s]
            for v in order:
                for w in left.intersection({b for a, b in links if a == v} | {a for a, b in links if b == v}) - depth.keys():
                    depth[w] = depth[v] + 1
                    order.append(w)
            total += sum(1 / d for d in depth.values() if d)
        want[f] = total / (len(asked) * (len(vids) - 1))
    monkeypatch.setattr(graph, "distances", None)
    monkeypatch.setattr(graph, "BITS", 5)
    tables = [spark.createDataFrame(rows, kind) for rows, kind in (([(v,) for v in vids], "vid long"), (links, "src long, dst long"), (list(rank.items()), "vid long, rnk long"), ([(v,) for v in asked], "source long"))]
    for chunk in (1 << 20, 1):
        told = removal.efficiency_curve(*tables, [0, 100, 400], chunk)
        assert {r.permille: r.e for r in told.collect()} == pytest.approx(want)


@pytest.mark.parametrize("directed", [False, True])
def test_pairs_apart(monkeypatch, directed):
    """Searches that carry all sources as bits count the pairs of plain searches; hubs, lone vertices and several blocks included."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(hops, "NEIGHBOURS", 3)
    for n, m, asked in ((1, 0, 1), (60, 50, 60), (300, 700, 300), (300, 320, 41)):
        tail, head = rng.integers(0, n, (2, m))
        tail[: m // 6] = 0
        if not directed:
            tail, head = np.concatenate([tail, head]), np.concatenate([head, tail])
        sources_, want = rng.permutation(n)[:asked], Counter()
        out = defaultdict(set)
        for a, b in zip(tail.tolist(), head.tolist(), strict=True):
            out[a].add(b)
        for s in sources_.tolist():
            depth, order = {s: 0}, [s]
            for v in order:
                for w in out[v] - depth.keys():
                    depth[w] = depth[v] + 1
                    order.append(w)
            want.update(d for d in depth.values() if d)
        for words in (1, 3 * n):
            assert hops.apart(n, tail, head, sources_, words) == [want[d] for d in range(1, max(want, default=0) + 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_efficiency_between_all_vertices(spark):
    """curve_with_e takes every vertex for a source, in code and SQL."""
    whole, around, total = Whole(), defaultdict(list), 0.0
    for a, b in whole.edges:
        around[a].append(b), around[b].append(a)
    for s in whole.nodes:
        depth, order = {s: 0}, [s]
        for v in order:
            for w in around[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
        total += sum(1 / d for d in depth.values() if d)
    n, told = len(whole.nodes), {r.permille: r.e for r in queries.QUERIES["curve_with_e"](spark, SF).collect()}
    assert told[0] == pytest.approx(total / (n * (n - 1)), abs=1e-9) and told[200] is not None
    assert "LIMIT" not in queries.ORACLES["curve_with_e"]


def test_links_labelled_in_ranges(spark, monkeypatch):
    """Ranges of ids that share nodes come to the components of all links."""
    pairs = [(k, k + 7) for k in range(40)] + [(500 + k, 501 + k) for k in range(0, 40, 2)] + [(-5, 3)]
    want = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    monkeypatch.setattr("egress.operators.components.RANGE", 8)
    links, nodes = labelled_links(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r.node: r.comp for r in nodes.collect()} == want
    assert sorted((r.src, r.dst, r.comp) for r in links.collect()) == sorted((a, b, want[a]) for a, b in pairs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_contraction_of_all_line_items(spark):
    """Contraction to the end against chains walked in plain Python."""
    around = defaultdict(set)
    for a, b in Whole().edges:
        around[a].add(b), around[b].add(a)
    rounds = 0
    while middle := {v for v, n in around.items() if len(n) == 2}:
        rounds, seen, bridges = rounds + 1, set(), []
        for v in middle:
            if v not in seen:
                chain, ends = [v], []
                seen.add(v)
                for x in chain:
                    for y in around[x]:
                        if y not in middle:
                            ends.append(y)
                        elif y not in seen:
                            seen.add(y), chain.append(y)
                bridges += [tuple(ends)] if len(ends) == 2 and ends[0] != ends[1] else []
        left = {v: n - middle for v, n in around.items() if v not in middle}
        for a, b in bridges:
            left[a].add(b), left[b].add(a)
        around = defaultdict(set, {v: n for v, n in left.items() if n})
    row = queries.QUERIES["contract_fixpoint"](spark, SF).first()
    assert (row.n, row.m, row.rounds) == (len(around), sum(map(len, around.values())) // 2, rounds)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_raster_share_of_every_vertex(spark):
    got = queries.QUERIES["raster_share"](spark, SF).groupBy("eid").agg(F.sum("share").alias("share")).collect()
    assert sorted(r.eid for r in got) == [r[0] for r in duckdb.sql(f"SELECT c_custkey FROM '{SF}/customer.parquet' ORDER BY 1").fetchall()]
    assert all(abs(r.share - 1) < 1e-5 for r in got)


def plain_flow(arcs, sources_, targets):
    """Augmenting paths, breadth first."""
    cap, around = defaultdict(float), defaultdict(set)
    for a, b, c in [*arcs, *((-1, s, 1e12) for s in sources_), *((t, -2, 1e12) for t in targets)]:
        cap[a, b] += c
        around[a].add(b), around[b].add(a)
    total = 0.0
    while True:
        came, queue = {-1: None}, [-1]
        for v in queue:
            for w in around[v]:
                if w not in came and cap[v, w] > 0:
                    came[w] = v
                    queue.append(w)
        if -2 not in came:
            return total
        path, v = [], -2
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        least = min(cap[e] for e in path)
        for a, b in path:
            cap[a, b] -= least
            cap[b, a] += least
        total += least


def test_flows_of_a_grid(spark):
    """Streets with cycles, both ways with capacities of their own: both flows against augmenting paths."""
    rnd = random.Random(17)
    streets = [(a, b, float(rnd.randint(1, 9))) for v in range(16) for w in (v + 1, v + 4) if w < 16 and (w != v + 1 or w % 4) for a, b in ((v, w), (w, v))]
    arcs = spark.createDataFrame([("g", k, a, b, c, 1.0, 0, 1.0) for k, (a, b, c) in enumerate(streets)], ARCS)
    own, goals = {0, 1, 4}, {11, 14}
    side = lambda vs: spark.createDataFrame([("g", v) for v in sorted(vs)], "unit string, vid long")
    row = flow.accessibility(arcs, side(own), side(goals), 1).first()
    assert row.capacity_vph == plain_flow(streets, own, goals)
    assert row.n_disjoint == plain_flow([(a, b, 1.0) for a, b, _ in streets], own, goals)


def even_odd(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


BENT = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (6.0, 9.0), (6.0, 3.0), (3.0, 3.0), (3.0, 9.0), (0.0, 9.0)]]
TRIANGLE = [[(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]]
HOLED = [[(-1.0, -1.0), (10.0, -1.0), (10.0, 10.0), (-1.0, 10.0)], [(2.0, 2.0), (7.5, 3.0), (4.0, 8.0)], [(4.2, 4.0), (5.0, 4.0), (5.0, 5.0), (4.2, 5.0)]]
PARTS = [[(0.0, 0.0), (3.0, 0.0), (1.5, 4.0)], [(6.0, 6.0), (10.0, 7.0), (7.0, 10.0)]]
ROUND = [[(5 + 4.5 * math.cos(2 * math.pi * k / 100_000), 5 + 4.5 * math.sin(2 * math.pi * k / 100_000)) for k in range(100_000)]]


def polygon(spark, rings):
    return spark.createDataFrame([(1, 2, [[{"x": x, "y": y} for x, y in r] for r in rings])], "pid int, level int, rings array<array<struct<x:double,y:double>>>")


@pytest.mark.parametrize("rings", [BENT, TRIANGLE, HOLED, PARTS, ROUND], ids=["bent", "triangle", "holed", "parts", "round"])
def test_overlay_of_rings(spark, rings):
    """Rings that are not convex, with holes and parts, over many tiles that they touch or not, against a fine walk along each segment."""
    rnd = random.Random(3)
    lines = [(k, *(round(rnd.uniform(-2, 11), 3) for _ in range(4))) for k in range(20)] + [(30, -1.0, 2.0, 10.0, 2.0), (31, 4.0, -1.0, 4.0, 10.0), (32, 1.0, 1.0, 1.0, 1.0)]
    segments = spark.createDataFrame(lines, "eid long, x0 double, y0 double, x1 double, y1 double")
    got = {r.eid: r.share for r in hazard.overlay_polygons(segments, polygon(spark, rings), 2.0).collect()}
    inside = (lambda x, y: math.hypot(x - 5, y - 5) < 4.5) if rings is ROUND else (lambda x, y: even_odd(rings, x, y))
    for k, x0, y0, x1, y1 in lines:
        steps = 4000
        want = sum(inside(x0 + (x1 - x0) * (i + 0.5) / steps, y0 + (y1 - y0) * (i + 0.5) / steps) for i in range(steps)) / steps if (x0, y0) != (x1, y1) else 0
        assert got.get(k, 0.0) == pytest.approx(want, abs=2e-3)
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True))) / 2
    signs = [1, -1, 1] if rings is HOLED else [1, 1]
    total = spatial.tile_pieces(polygon(spark, rings), 2.0).agg(F.sum("area").alias("a")).first().a
    assert total == pytest.approx(sum(s * area(r) for s, r in zip(signs, rings, strict=False)))


@pytest.mark.parametrize("size", [1.7, 50.0])
def test_burn_share_of_bent_polygons(spark, size):
    """Neither convex, with holes and parts, against a fine grid."""
    shapes = {"bent": BENT, "triangle": TRIANGLE, "holed": HOLED, "parts": PARTS}
    areas, fires = (spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in v]) for k, v in shapes.items()], f"{name} string, rings array<array<struct<x:double,y:double>>>") for name in ("area", "fire"))
    got = {(r.area, r.fire): r.share for r in spatial.burn_shares(areas, fires, size).collect()}
    cells = [(-1 + (i + 0.5) * 0.1, -1 + (j + 0.5) * 0.1) for i in range(110) for j in range(110)]
    inside = {k: {c for c in cells if even_odd(v, *c)} for k, v in shapes.items()}
    for a, b in itertools.product(shapes, shapes):
        assert got.get((a, b), 0.0) == pytest.approx(len(inside[a] & inside[b]) / len(inside[a]), abs=0.02)
    assert all(got[k, k] == pytest.approx(1.0) for k in shapes)


@pytest.mark.parametrize("size", [0.7, 2.0, 30.0])
def test_distance_to_polygons(spark, size):
    """Inside, outside and far from a bent polygon, over small and large tiles."""
    rnd = random.Random(6)
    rows = [(k, rnd.uniform(-6, 15), rnd.uniform(-6, 15)) for k in range(80)] + [(80, 4.5, 3.0), (81, 0.0, 0.0)]

    def far(x, y):
        if even_odd(BENT, x, y):
            return 0.0
        ring, best = BENT[0], math.inf
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            best = min(best, math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y))
        return best

    got = {r.vid: r.distance for r in spatial.near_polygons(spark.createDataFrame(rows, "vid long, x double, y double"), polygon(spark, BENT), 2.5, size).collect()}
    want = {k: far(x, y) for k, x, y in rows}
    assert got == pytest.approx({k: d for k, d in want.items() if d <= 2.5})


def test_points_keep_their_columns(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0, "mine", "too"), (1, 4.5, 4.5, "mine", "too"), (2, 3.5, 4.2, "mine", "too")], "pid long, x double, y double, tile string, piece string")
    got = spatial.points_in(points, polygon(spark, HOLED).drop("pid"), 2.0).orderBy("pid").collect()
    assert [(r.pid, r.tile, r.piece, r.level) for r in got] == [(0, "mine", "too", 2), (1, "mine", "too", 2)]
    empty = spark.createDataFrame([(1, [])], "level int, rings array<array<struct<x:double,y:double>>>")
    assert spatial.points_in(points, empty, 2.0).count() == 0 and spatial.points_in(points, empty, 2.0, "left").count() == 3


def test_nearest_of_far_and_crowded_points(spark):
    rnd = random.Random(5)
    sites = [("g", k, rnd.gauss(0, 0.01), rnd.gauss(0, 0.01)) for k in range(60)] + [("g", 60, 40.0, 40.0), ("one", 61, 5.0, 5.0), ("gone", 62, None, 1.0)]
    points = [("g", k, rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for k in range(40)] + [("one", 90, -1e4, 7.0), ("none", 91, 0.0, 0.0), ("gone", 92, 0.0, 0.0)]
    q = spark.createDataFrame(points, "grp string, qid long, x double, y double")
    s = spark.createDataFrame(sites, "grp string, sid long, x double, y double")
    want = {i: min((math.hypot(x - a, y - b), k) for h, k, a, b in sites if h == g)[1] for g, i, x, y in points if g in ("g", "one")}
    assert {r.qid: r.sid for r in spatial.nearest(q, s, ["grp"]).collect()} == want


def test_graph_steps_are_dealt_by_rows(spark, monkeypatch):
    """Edges and nodes come as SQL tells them, in parts that grow with the line items."""
    from egress.plans import fixtures

    monkeypatch.setattr(fixtures, "PART_ROWS", 500)
    t = fixtures.Tables(spark, "/root/testdata/sf0.001")
    assert t.parts() == -(-t["lineitem"].count() // 500) > 8
    for got, text in ((t.edges(), fixtures.EDGES), (t.nodes(), fixtures.NODES)):
        assert got.rdd.getNumPartitions() == t.parts()
        assert sorted(got.collect()) == sorted(t.sql(text).collect())


def test_sources_of_efficiency_grow(spark):
    """Every 101st line-item vertex is a source, however many there are."""
    from egress.plans import fixtures

    sizes = []
    for sf in ("0.001", "0.01"):
        t = fixtures.Tables(spark, f"/root/testdata/sf{sf}")
        sizes.append(t.sql(queries._GROWING).count())
        assert sizes[-1] == t.nodes().filter("vid % 101 = 0 AND vid > 0").count()
    assert sizes[1] > 5 * sizes[0] and "LIMIT" not in queries.ORACLES["efficiency"]
