"""Drivers who route themselves, region by region.

All that a round of settling needs lies with a region's arcs: their times of the last round,
the fastest way on from each vertex, loads, and how far each way is throttled. Three phases
follow each other, and each goes on until nothing crosses a border any more: distances to the
targets spread inwards, loads run down the tree of next arcs, throttles run back up. So a
round carries a row for each loaded arc, not one for each origin and arc of its way. A unit of one region is done in one go.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from egress.operators.regions import _lists, _placed, _rows, by_region, of_arcs, singly
from egress.plans.store import released, written

INF = float("inf")
#: Times are this many seconds at least, so that ways never turn in a circle.
TICK = 1e-9

_ARC = pa.struct([("eid", pa.int64()), ("src", pa.int64()), ("dst", pa.int64()), ("there", pa.int64()), ("cap", pa.float64()), ("t0", pa.float64()), ("t", pa.float64()), ("load", pa.float64())])
_NODE = pa.struct([("vid", pa.int64()), ("w", pa.float64()), ("sink", pa.bool_()), ("edge", pa.bool_()), ("dist", pa.float64()), ("part", pa.float64())])
_AROUND = pa.struct([("vid", pa.int64()), ("dist", pa.float64()), ("part", pa.float64())])
_OUTER = pa.struct([("vid", pa.int64()), ("there", pa.int64())])
_HUNG = pa.struct([("vid", pa.int64()), ("theta", pa.float64()), ("w", pa.float64())])
_SENT = pa.struct([("vid", pa.int64()), ("there", pa.int64()), ("value", pa.float64())])
_SQL = {
    "arcs": "array<struct<eid:bigint,src:bigint,dst:bigint,there:bigint,cap:double,t0:double,t:double,load:double>>", "nodes": "array<struct<vid:bigint,w:double,sink:boolean,edge:boolean,dist:double,part:double>>",
    "around": "array<struct<vid:bigint,dist:double,part:double>>", "outer": "array<struct<vid:bigint,there:bigint>>", "hung": "array<struct<vid:bigint,theta:double,w:double>>", "sent": "array<struct<vid:bigint,there:bigint,value:double>>",
    "delivered": "double", "lost": "double", "ratio": "double", "mark": "string", "rounds": "int", "converged": "boolean",
}
_NEWS = "array<struct<vid:bigint,value:double>>"


class Region:
    """One region's arcs (by their tails) and vertices, and what is known of the vertices across its border."""

    def __init__(self, demand: float, arcs: dict, nodes: dict, around: dict, outer: dict, hung: dict):
        self.demand = demand
        self.eid, self.src, self.dst, self.there, self.cap, self.t0, self.t, self.load = (arcs[c].tolist() for c in ("eid", "src", "dst", "there", "cap", "t0", "t", "load"))
        self.vids, self.w, self.sink, self.edge, self.dist, self.part = (nodes[c].tolist() for c in ("vid", "w", "sink", "edge", "dist", "part"))
        self.index = {v: k for k, v in enumerate(self.vids)}
        self.known = {v: [d, p] for v, d, p in zip(*(around[c].tolist() for c in ("vid", "dist", "part")), strict=True)}
        self.outer = list(zip(outer["vid"].tolist(), outer["there"].tolist(), strict=True))
        self.hung = [(self.index[v], theta, w) for v, theta, w in zip(*(hung[c].tolist() for c in ("vid", "theta", "w")), strict=True)]
        self.own = list(self.w)  # without what hangs on the vertex
        for v, _, w in self.hung:
            self.own[v] -= w
        for d in self.dst:
            if d not in self.index:
                self.known.setdefault(d, [INF, -1.0])
        self.tail = [self.index[s] for s in self.src]
        self.head = [self.index.get(d) for d in self.dst]
        self.out: list[list[int]] = [[] for _ in self.vids]
        self.into: list[list[int]] = [[] for _ in self.vids]
        self.entries: dict[int, list[int]] = {}  # by the vertex across the border
        for e, (a, b) in enumerate(zip(self.tail, self.head, strict=True)):
            self.out[a].append(e)
            (self.entries.setdefault(self.dst[e], []) if b is None else self.into[b]).append(e)
        self.free = [max(t, TICK) for t in self.t0]

    @property
    def alone(self) -> bool:
        return not self.outer and not self.known

    def _far(self, e: int) -> float:
        head = self.head[e]
        return self.known[self.dst[e]][0] if head is None else self.dist[head]

    def _told(self, before: list[float], now: list[float], least: float) -> list[tuple[int, int, float]]:
        """What changed at the border, for the regions that have arcs into it."""
        return [(v, t, now[self.index[v]]) for v, t in self.outer if now[self.index[v]] != before[self.index[v]] and now[self.index[v]] > least]

    def start(self) -> list:
        """Times by the last round's loads, then distances afresh."""
        self.t = list(self.free)
        for e, x in enumerate(self.load):
            if x > 0 and x > self.cap[e]:
                self.t[e] = max(self.t0[e] * x / self.cap[e], TICK) if self.cap[e] > 0 else INF
        self.load, self.dist, self.part = [0.0] * len(self.t), [INF] * len(self.vids), [-1.0] * len(self.vids)
        self.known = {v: [INF, -1.0] for v in self.known}
        return self.times([])

    def times(self, news: list[tuple[int, float]]) -> list:
        for v, d in news:
            self.known[v][0] = min(self.known[v][0], d)
        before, tail, t = self.dist, self.tail, self.t
        dist = [0.0 if s else INF for s in self.sink]
        first = [(0.0, self.into[v]) for v, s in enumerate(self.sink) if s] + [(d, self.entries[v]) for v, (d, _) in self.known.items() if d < INF and v in self.entries]
        for d, arcs in first:
            for e in arcs:
                if d + t[e] < dist[tail[e]]:
                    dist[tail[e]] = d + t[e]
        heap = [(d, v) for v, (d, s) in enumerate(zip(dist, self.sink, strict=True)) if d < INF and not s]
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for e in self.into[v]:
                if d + t[e] < dist[tail[e]]:
                    dist[tail[e]] = d + t[e]
                    heapq.heappush(heap, (d + t[e], tail[e]))
        self.dist = dist
        return self._told(before, dist, -1.0)

    def next_arc(self, v: int) -> int | None:
        """The arc on the fastest way, the smaller id of equals; none at a target or without a way."""
        best = None if self.sink[v] else min(((self.t[e] + self._far(e), self.eid[e], e) for e in self.out[v] if self.t[e] + self._far(e) < INF), default=None)
        return None if best is None else best[2]

    def loads(self, news: list[tuple[int, float]] | None) -> list:
        """Traffic of our own origins (``news`` None), or what came over the border, down the tree of next arcs."""
        flow = [0.0] * len(self.vids)
        if news is None:
            flow = [w * self.demand if d < INF and not s else 0.0 for w, d, s in zip(self.w, self.dist, self.sink, strict=True)]
        for v, x in news or []:
            flow[self.index[v]] += x
        sent = {}
        for v in sorted(range(len(flow)), key=lambda v: (-self.dist[v], v)):
            e = self.next_arc(v) if flow[v] > 0 else None
            if e is not None:
                self.load[e] += flow[v]
                if self.head[e] is None:
                    sent[self.dst[e], self.there[e]] = sent.get((self.dst[e], self.there[e]), 0.0) + flow[v]
                else:
                    flow[self.head[e]] += flow[v]
        return [(v, t, x) for (v, t), x in sent.items()]

    def throttles(self, news: list[tuple[int, float]]) -> list:
        """The least part served on the way from each loaded vertex, as far as it is known. A loaded arc is its tail's next."""
        for v, p in news:
            self.known[v][1] = p
        before, part = self.part, [1.0 if s else -1.0 for s in self.sink]
        for e in sorted((e for e, x in enumerate(self.load) if x > 0), key=lambda e: (self.dist[self.tail[e]], self.tail[e])):
            on = self.known[self.dst[e]][1] if self.head[e] is None else part[self.head[e]]
            part[self.tail[e]] = -1.0 if on < 0 else min(on, 1.0, self.cap[e] / max(self.load[e], 1e-9))
        self.part = part
        return self._told(before, part, -0.5)

    def summary(self) -> tuple[float, float, float, str]:
        """(delivered, weight without a way, greatest load to capacity, digest of the loaded ways)."""
        delivered = sum(w * self.demand * p for w, p, s in zip(self.own, self.part, self.sink, strict=True) if w > 0 and p > 0 and not s)
        delivered += sum(w * min(self.demand * self.part[v], theta) for v, theta, w in self.hung if self.part[v] > 0)
        lost = sum(w for w, d, s in zip(self.w, self.dist, self.sink, strict=True) if w > 0 and d == INF and not s)
        ratio = max([0.0, *(x / max(c, 1e-9) for x, c in zip(self.load, self.cap, strict=True) if x > 0), *(self.demand / theta for v, theta, _ in self.hung if self.sink[v] or self.dist[v] < INF)])
        ways = sorted((s, e) for s, e, x in zip(self.src, self.eid, self.load, strict=True) if x > 0)
        return delivered, lost, ratio, hashlib.blake2b(np.array(ways, "<i8").tobytes(), digest_size=16).hexdigest()

    def settled(self, most: int) -> tuple[float | str | int | bool | None, ...]:
        """All rounds of a unit that lies within the region; the summary at its end, rounds, and whether the ways stayed the same. No rounds if drivers would ever get to the edge."""
        first, told, rim = {}, [], [e for e, v in enumerate(self.head) if self.edge[v]]
        while True:
            self.start(), self.loads(None)
            if any(self.load[e] > 0 for e in rim):
                return (None,) * 6
            self.throttles([])
            delivered, lost, ratio, mark = self.summary()
            told.append((delivered, ratio))
            if mark in first or len(told) == most:
                cycle = told[first.get(mark, most - 2) + 1 :]
                return sum(d for d, _ in cycle) / len(cycle), lost, max(r for _, r in cycle), mark, len(told), mark in first and len(cycle) == 1
            first[mark] = len(told) - 1

    def state(self) -> tuple[dict, dict, dict]:
        return (
            {"eid": self.eid, "src": self.src, "dst": self.dst, "there": self.there, "cap": self.cap, "t0": self.t0, "t": self.t, "load": self.load},
            {"vid": self.vids, "w": self.w, "sink": self.sink, "edge": self.edge, "dist": self.dist, "part": self.part},
            {"vid": list(self.known), "dist": [d for d, _ in self.known.values()], "part": [p for _, p in self.known.values()]},
        )


def _phase(name: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One job's work on rows (unit, region, d, arcs, nodes, around, outer, hung, news): start, times, loads (own, then what comes), throttles. A region that hears nothing in a phase stays as it is; a unit of one region is settled at the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in singly(batches):
            demand, heard = row.column("d")[0].as_py(), next(_lists(row.column("news")))
            arcs, nodes, around, outer, hung = (next(_lists(row.column(c))) for c in ("arcs", "nodes", "around", "outer", "hung"))
            r, sent = Region(demand, arcs, nodes, around, outer, hung), []
            news = list(zip(heard["vid"].tolist(), heard["value"].tolist(), strict=True))
            if r.alone:
                plain = [*r.settled(most), False]
            else:
                if name == "start":
                    sent = r.start()
                elif name in ("own loads", "own throttles"):
                    sent = r.loads(None) if name == "own loads" else r.throttles([])
                elif news:
                    sent = {"times": r.times, "loads": r.loads, "throttles": r.throttles}[name](news)
                plain = [*r.summary(), None, None, True]
            fields = {"vid": [x[0] for x in sent], "there": [x[1] for x in sent], "value": [x[2] for x in sent]}
            lists = [_rows([p], k) for p, k in zip((*r.state(), outer, hung, fields), (_ARC, _NODE, _AROUND, _OUTER, _HUNG, _SENT), strict=True)]
            plain = [pa.array([p], k) for p, k in zip(plain, (pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([row.column("unit"), row.column("region"), row.column("d"), *lists, *plain], names=["unit", "region", "d", *_SQL, "open"])

    return run


def _laid(arcs: DataFrame, weights: DataFrame, targets: DataFrame, demand: DataFrame, regions: DataFrame, hung: DataFrame | None, edge: DataFrame | None = None) -> DataFrame:
    """Rows (unit, region, d, arcs, nodes, around, outer, hung), once for all rounds."""
    ends = written(_placed(_placed(arcs.select("unit", "eid", "src", "dst", F.col("cap").cast("double").alias("cap"), F.col("t0").cast("double").alias("t0")).filter("src != dst"), regions, "src", "region"), regions, "dst", "there"), "routes-arcs")
    zero, no = F.lit(0.0).alias("w"), F.lit(False).alias("sink")
    inside = F.lit(False).alias("edge")
    marks = ends.select("unit", F.col("src").alias("vid"), zero, no, inside).union(ends.select("unit", "dst", zero, no, inside)).union(weights.select("unit", "vid", F.col("w").cast("double"), no, inside)).union(targets.select("unit", "vid", zero, F.lit(True), inside))
    if edge is not None:
        marks = marks.union(edge.select("unit", "vid", zero, F.lit(True), F.lit(True)))
    nodes = _placed(marks.groupBy("unit", "vid").agg(F.sum("w").alias("w"), F.max("sink").alias("sink"), F.max("edge").alias("edge")), regions, "vid", "region")
    held = nodes.groupBy("unit", "region").agg(F.array_sort(F.collect_list(F.struct("vid", "w", "sink", "edge", F.lit(INF).alias("dist"), F.lit(-1.0).alias("part")))).alias("nodes"))
    own = ends.groupBy("unit", "region").agg(F.array_sort(F.collect_list(F.struct("eid", "src", "dst", "there", "cap", "t0", F.col("t0").alias("t"), F.lit(0.0).alias("load")))).alias("arcs"))
    outer = ends.filter("region != there").select("unit", F.col("there").alias("region"), F.col("dst").alias("vid"), F.col("region").alias("there")).distinct().groupBy("unit", "region").agg(F.array_sort(F.collect_list(F.struct("vid", "there"))).alias("outer"))
    rows = held.join(own, ["unit", "region"], "left").join(outer, ["unit", "region"], "left").join(demand.select("unit", F.col("d").cast("double").alias("d")), "unit")
    none = {c: F.array().cast(_SQL[c]) for c in ("arcs", "around", "outer", "hung")}
    if hung is None:
        rows = rows.withColumn("hung", none["hung"])
    else:
        at = _placed(hung, regions, "vid", "region").groupBy("unit", "region").agg(F.array_sort(F.collect_list(F.struct("vid", "theta", "w"))).alias("hung"))
        rows = rows.join(at, ["unit", "region"], "left")
    return written(by_region(rows).select("unit", "region", "d", F.coalesce("arcs", none["arcs"]).alias("arcs"), "nodes", none["around"].alias("around"), F.coalesce("outer", none["outer"]).alias("outer"), F.coalesce("hung", none["hung"]).alias("hung")), "routes-regions")


def settle(arcs: DataFrame, weights: DataFrame, targets: DataFrame, demand: DataFrame, most_rounds: int = 60, regions: DataFrame | None = None, hung: DataFrame | None = None, edge: DataFrame | None = None) -> DataFrame:
    """(unit, ratio, delivered, unreachable, rounds, converged) of drivers who each take the fastest path at the last round's congested times.

    Arcs (unit, eid, src, dst, cap, t0), weights (unit, vid, w) that sum to 1, demand (unit, d).
    An arc loaded over its capacity takes t0 x load / capacity next round. A unit whose ways
    repeat the last round's has converged; one whose ways return to an earlier round's
    oscillates, and gets the mean delivery and the largest ratio of the cycle. Ways are compared by
    a 128-bit digest of the loaded arcs, in order. Origins on a
    target have no arc to deliver over, and those without a way out deliver nothing either;
    only the latter are unreachable. All units settle side by side. ``regions``: (vid, region), else by id.
    ``hung``: (unit, vid, theta, w), what :func:`egress.operators.deadends.hung` says of the dead ends that were taken off; their weights are part of ``weights``.
    ``edge``: (unit, vid), where the network around the origins (:mod:`egress.operators.nearby`) ends, all in one region. Each is as near as a target;
    a unit in which drivers ever go there is left out, in the others everyone goes as in the whole network.
    """
    kind = arcs.schema["unit"].dataType.simpleString()
    schema = ", ".join([f"unit {kind}, region bigint, d double", *(f"{k} {v}" for k, v in _SQL.items()), "open boolean"])
    regions = of_arcs(arcs) if regions is None else regions
    state, silence = _laid(arcs, weights, targets, demand, regions, hung, edge), F.array().cast(_NEWS)
    columns, history, done, last = ["unit", "region", "d", "arcs", "nodes", "around", "outer", "hung"], [], [], state

    n = state.count()

    def run(name: str, rows: DataFrame, told: DataFrame | None = None) -> tuple[DataFrame, dict]:
        """One job of a phase; ``told``: the rows whose news are heard."""
        nonlocal last
        rows = rows.select(columns)
        if told is None:
            rows = rows.withColumn("news", silence)
        else:
            news = told.select("unit", F.explode("sent").alias("s")).groupBy("unit", F.col("s.there").alias("region")).agg(F.collect_list(F.struct("s.vid", "s.value")).alias("news"))
            rows = rows.join(news, ["unit", "region"], "left").withColumn("news", F.coalesce("news", silence))
        seen = Observation()
        dealt = by_region(rows, n) if edge is None else rows.repartition(4 * n + 1, "unit", "region")
        out = written(dealt.mapInArrow(_phase(name, most_rounds), schema).observe(seen, F.count_if(F.size("sent") > 0).alias("sent"), F.count_if("open").alias("open")), "routes-phase")
        released(last)
        last = out
        return out, seen.get

    for k in range(1, most_rounds + 1):
        table, seen = run("start", state)
        if k == 1:
            alone = table.filter("rounds IS NOT NULL").select("unit", "delivered", "ratio", F.col("lost").alias("unreachable"), "rounds", "converged")
            done.append(written(alone, "settle-ended"))
            if not seen["open"]:
                break
            table = table.filter("open")
        for phase in ("times", "loads", "throttles"):
            if phase != "times":
                table, seen = run(f"own {phase}", table)
            while seen["sent"]:
                table, seen = run(phase, table, table)
        marks = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "mark"))), lambda x: x["mark"]), ","), 256)
        row = table.groupBy("unit").agg(F.lit(k).alias("k"), F.sum("delivered").alias("delivered"), F.max("ratio").alias("ratio"), F.sum("lost").alias("unreachable"), marks.alias("mark"))
        seen_rows, seen_ended = Observation(), Observation()
        history.append(written(row.observe(seen_rows, F.count("*").alias("n")), "settle-round"))
        every = reduce(DataFrame.unionByName, history)
        first = every.groupBy("unit", "mark").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n"))
        again = first.filter((F.col("last") == k) & ((F.col("n") > 1) | F.lit(k == most_rounds)))
        span = every.join(again.select("unit", "first", "n"), "unit").filter((F.col("k") > F.col("first")) | (F.col("n") == 1))
        ended = span.groupBy("unit").agg(F.avg("delivered").alias("delivered"), F.max("ratio").alias("ratio"), F.max("unreachable").alias("unreachable"), F.max("k").alias("rounds"), ((F.count("*") == 1) & (F.max("n") > 1)).alias("converged"))
        done.append(written(ended.observe(seen_ended, F.count("*").alias("n")), "settle-ended"))
        if seen_ended.get["n"] == seen_rows.get["n"]:
            break
        state = table.join(done[-1].select("unit"), "unit", "left_anti") if seen_ended.get["n"] else table
    released(last, *history)
    return reduce(DataFrame.unionByName, done)
