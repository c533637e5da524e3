"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from egress.plans.store import released, written

#: Nodes held at once in a partition.
LOCAL_NODES = 500_000
#: Links that a task of :func:`labelled_links` labels at once.
RANGE = 1 << 20
#: Stars that one task finishes.
ONE_TASK = 1 << 15


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the least of itself and its neighbours: the larger ones (large star), or the smaller ones and itself (small star). ``edges``: u > v. A link may come more than once."""
    if large:
        around = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's links as stars around their least node: union-find over the partition's own links, told whenever many nodes are held."""
    parent: dict = {}

    def root(x):  # noqa: ANN001, ANN202
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def told() -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(root, nodes), kind)], names=["u", "v"])

    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > LOCAL_NODES:
            yield told()
            parent = {}
    if parent:
        yield told()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``links`` (a, b): comp is the component's least node. Nodes may be of any type that Arrow and Python order alike, or structs.

    Links shrink to stars inside each partition as they are read. Once no more than
    ONE_TASK stars are left, one task finishes them; beyond that come rounds of a large
    and a small star, whose number grows with the logarithm of the size. Each round is
    written to the shared folder and the one before is deleted, so a lost executor costs
    one round at most. A node with many links is a hot join key, which adaptive execution
    splits.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    kind = edges.schema["u"].dataType
    local = isinstance(kind, (T.LongType, T.IntegerType, T.StringType, T.BinaryType))
    stars = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    known = None
    if local:
        seen = Observation()
        edges = written(edges.mapInArrow(_local_stars, stars).observe(seen, F.count("*").alias("n")), "components")
        if seen.get["n"] <= ONE_TASK:
            return _told(edges.coalesce(1).mapInArrow(_local_stars, stars))
    while True:
        seen, last = Observation(), edges
        edges = edges.mapInArrow(_local_stars, stars) if local and known is not None else edges
        edges = _star(_star(edges, True), False).distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        edges = written(edges, "components")
        if local or known is not None:
            released(last)
        if seen.get == known:
            return _told(edges)
        known = seen.get


def _told(stars: DataFrame) -> DataFrame:
    """A row for each node of stars (u, v) around the least nodes v."""
    centres = stars.select("v").distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(centres.select(F.col("v").alias("node"), F.col("v").alias("comp")))


def _local_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (src, dst) with the least node that RANGE links of the partition at a time join them to."""

    def told(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some)
        ends = np.concatenate([table.column(c).to_numpy() for c in ("src", "dst")])
        ids, at = np.unique(ends, return_inverse=True)
        n, parent = len(at) // 2, list(range(len(ids)))
        for a, b in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
        for x, p in enumerate(parent):  # a parent is smaller, and so has been told its root before
            parent[x] = parent[p]
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ends[:n], ends[n:], ids[np.asarray(parent)[at[:n]]]))], names=["src", "dst", "label"])

    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= RANGE:
            yield told(held)
            held, rows = [], 0
    if rows:
        yield told(held)


def labelled_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (src, dst, comp), nodes (node, comp)) of links (src, dst) between whole numbers: comp is the component's least node.

    For large tables: links are dealt out in ranges of ids and labelled in each range; a node that has several labels
    links them, and only these links of labels go through :func:`components`. It pays where near ids are linked; the rows are the same anyhow.
    """
    plain = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src != dst")
    parts = max(1, ceil(plain.count() / RANGE))
    links = written((plain.repartitionByRange(parts, "src") if parts > 1 else plain.coalesce(1)).mapInArrow(_local_labels, "src long, dst long, label long"), "labelled-links")
    each = links.select(F.explode(F.array("src", "dst")).alias("node"), "label")
    nodes = written(each.groupBy("node").agg(F.min("label").alias("label"), F.collect_set("label").alias("labels")).select("node", "label", F.when(F.size("labels") > 1, F.col("labels")).alias("labels")), "labelled-nodes")
    joined = nodes.filter("labels IS NOT NULL").select(F.col("label").alias("a"), F.explode("labels").alias("b")).filter("a != b").distinct()
    known = written(components(written(joined, "labelled-labels")), "labelled-known").select(F.col("node").alias("label"), "comp")
    named = lambda df, c: df.join(known, "label", "left").select(*c, F.coalesce("comp", "label").alias("comp"))
    return named(links, ["src", "dst"]), named(nodes, ["node"])
