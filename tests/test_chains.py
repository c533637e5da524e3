"""Chains of streets against walks in plain Python."""

import random

from egress.operators import chains

ARCS = "eid long, src long, dst long, length_m double, travel_s double"


def test_a_long_chain(spark):
    """10,000 arcs become one, in their order, in rounds that grow with the logarithm."""
    ids = list(range(10_000))
    random.Random(3).shuffle(ids)
    rows = [(ids[k], k, k + 1, 1.0, 2.0) for k in range(10_000)]
    out = chains.simplified(spark.createDataFrame(rows, ARCS).repartition(4)).collect()
    assert [(r.eid, r.src, r.dst, r.length_m, r.travel_s, r.n, r.eids) for r in out] == [(ids[0], 0, 10_000, 10_000.0, 20_000.0, 10_000, ids)]


def test_streets_both_ways(spark):
    """Two-way chains, a one-way fork, a ring and a loop."""
    ways = [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (4, 5), (4, 6), (6, 7), (20, 21), (21, 22), (22, 20), (7, 7)]
    rows = [(k, a, b, 1.0 + k, 1.0) for k, (a, b) in enumerate(ways)]
    got = {(r.src, r.dst): (r.n, r.length_m, r.eids) for r in chains.simplified(spark.createDataFrame(rows, ARCS)).collect()}
    want = {(1, 4): (3, 9.0, [0, 2, 4]), (4, 1): (3, 12.0, [5, 3, 1]), (4, 5): (1, 7.0, [6]), (4, 7): (2, 17.0, [7, 8]), (7, 7): (1, 13.0, [12])}
    want |= {(20, 21): (1, 10.0, [9]), (21, 22): (1, 11.0, [10]), (22, 20): (1, 12.0, [11])}
    assert got == want


def test_random_streets(spark):
    rnd, rows = random.Random(8), []
    for c in range(60):
        hubs, inner = rnd.sample(range(20), 2), [1000 + 50 * c + k for k in range(rnd.randint(0, 12))]
        way = [hubs[0], *inner, hubs[1]]
        steps = list(zip(way, way[1:], strict=False))
        steps += [(b, a) for a, b in steps] if c % 3 else []
        rows += [(len(rows) + k, a, b, float(rnd.randint(1, 9)), 1.0) for k, (a, b) in enumerate(steps)]
    rows += [(len(rows) + 3 * h + k, h, 500 + 3 * h + k, 1.0, 1.0) for h in range(20) for k in range(3)]  # dead ends, so that every hub is a fork
    out = {}
    for e, a, b, *_ in rows:
        out.setdefault(a, []).append((e, b))
    length, want = {r[0]: r[3] for r in rows}, {}
    for e, a, b, *_ in rows:
        if a < 20:
            chain, last, at = [e], a, b
            while at >= 1000:
                nxt = next((x, w) for x, w in out[at] if w != last)
                chain.append(nxt[0])
                last, at = at, nxt[1]
            want[e] = (a, at, sum(length[x] for x in chain), chain)
    got = {r.eid: (r.src, r.dst, r.length_m, r.eids) for r in chains.simplified(spark.createDataFrame(rows, ARCS)).collect()}
    assert got == want
    assert sum(len(g[3]) for g in got.values()) == len(rows)
