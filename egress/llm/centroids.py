"""Clustering around centroids with exact integers and partial-distance search.

Vectors become integers once and lie in the shared folder as blocks of 4 bytes a component.
A round is one pass over them: each task finds the nearest centroid of its vectors and adds
them up by cluster, so that a row for each cluster and partition is all that moves, and the
number of rows of one cluster doesn't matter. Sums are whole numbers, so neither order nor
partitions change a centroid.

The nearest centroid is found on the dimensions in order of their variance over all vectors:
after the first block of them the likeliest centroid is finished, and the others add block
by block until they are strictly above the best found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.llm.store import released, written

SCALE, DIMS = 1024, 64
#: Components are held to this size, so that squared distances fit 64 bits; it is reached beyond +-131,072 only.
MOST = 1 << 27
#: Dimensions added at once.
BLOCK = 16


def quantized(df: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id, q (little-endian 32-bit integers) of the vectors with ``dims`` finite components: floor(scale x component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, dims)
            whole = np.clip(np.floor(values * scale), -MOST, MOST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([row.tobytes() for row in whole], pa.binary())], names=["id", "q"])

    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.filter((F.size(vector) == dims) & finite)
    rows = kept.select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return rows.mapInArrow(run, rows.schema["id"].dataType.simpleString().join(("id ", ", q binary")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (the smaller of equals) and the squared distance, by partial distances in the given order of dimensions."""
    x, c = vectors[:, order], centroids[:, order]
    part = np.stack([((x[:, :block] - one[:block]) ** 2).sum(axis=1) for one in c], axis=1)
    label = part.argmin(axis=1)
    rows = np.arange(len(x))
    best = part[rows, label] + ((x[:, block:] - c[label, block:]) ** 2).sum(axis=1)
    guess = label.copy()
    for k, one in enumerate(c):
        left = np.flatnonzero((guess != k) & (part[:, k] <= best))
        sums = part[left, k]
        for at in range(block, x.shape[1], block):
            sums = sums + ((x[left, at : at + block] - one[at : at + block]) ** 2).sum(axis=1)
            near = sums <= best[left]
            left, sums = left[near], sums[near]
            if not len(left):
                break
        won = (sums < best[left]) | (k < label[left])  # equal sums go to the smaller number
        best[left[won]], label[left[won]] = sums[won], k
    return label, best


def _by_variance(rows: DataFrame, dims: int) -> np.ndarray:
    """Dimensions, those of the largest variance over all vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = matrix(batch.column("q"), dims).astype(float)
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([float(n)] * dims), pa.array(one), pa.array(two)], names=["dim", "n", "one", "two"])

    sums = rows.select("q").mapInArrow(run, "dim int, n double, one double, two double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")])
    variance = {r["dim"]: r["two"] / r["n"] - (r["one"] / r["n"]) ** 2 for r in sums.filter("n > 0").collect()}
    return np.array(sorted(range(dims), key=lambda d: (-variance.get(d, 0.0), d)))


def _moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of each cluster's mean; an empty cluster keeps its centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = matrix(batch.column("q"), dims)
            label, _ = nearest(x, centroids, order)
            count += np.bincount(label, minlength=k)
            by = np.argsort(label, kind="stable")
            first = np.searchsorted(label[by], np.arange(k))
            some = np.flatnonzero(np.bincount(label, minlength=k))
            if len(some):
                sums[some] += np.add.reduceat(x[by], first[some], axis=0)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    told = rows.select("q").mapInArrow(run, "cluster int, n long, s array<long>").select("cluster", "n", F.posexplode("s").alias("dim", "s"))
    sums = told.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in sums.collect():  # clusters x dimensions
        out[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return out


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, seed: str = "3", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """One row per vector that is kept: id, cluster, distance (squared), inertia of its cluster and of all, digest of its centroid.

    Kept are vectors of ``dims`` components that are all finite. The first centroids are those
    with the smallest sha256 of seed, colon and id, ids that repeat in order of their vectors; with fewer
    vectors than ``k`` there are fewer clusters. A null id is hashed as empty text; repeated rows all count
    and are all told. Components beyond +-131,072 are held there, else distances would not fit
    64 bits. A table without vectors gives an empty result. Other columns are not read.
    What reaches the driver is ``k`` x ``dims`` numbers a round.
    """
    rows = written(quantized(df, id_col, vector_col, dims, scale), "vectors")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    start = rows.orderBy(F.sha2(text, 256), "q").limit(k).collect()
    centroids = np.array([np.frombuffer(r["q"], "<i4") for r in start], np.int64).reshape(-1, dims)
    if not len(centroids):
        none = rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
        return none.limit(0)
    order = _by_variance(rows, dims)
    for _ in range(rounds):
        centroids = _moved(rows, centroids, order)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, distance = nearest(matrix(batch.column("q"), dims), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    told = written(rows.mapInArrow(assign, rows.schema["id"].dataType.simpleString().join(("id ", ", cluster int, distance long"))), "vector-clusters")
    released(rows)
    found = {r["cluster"]: int(r["s"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    inertia: list[Column] = [of([found.get(c, 0) for c in range(len(centroids))]).cast("long"), F.lit(sum(found.values())).cast("long")]
    return told.select(F.col("id").alias(id_col), "cluster", "distance", inertia[0].alias("cluster_inertia"), inertia[1].alias("inertia"), of(digests).alias("centroid_sha256"))


def oracle_sql(k: int = 8, rounds: int = 10, seed: str = "3", dims: int = DIMS, scale: int = SCALE) -> str:
    """DuckDB SQL of :func:`clustered` on embeddings (vec_id, embedding)."""
    tables = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {k}) s)",
    ]
    label = "SELECT v.vec_id, v.q, min({{'d': list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c.c}}) AS m FROM (SELECT *, row_number() OVER () AS i FROM v) v, c{r} c GROUP BY v.i, v.vec_id, v.q"
    for r in range(1, rounds + 1):
        # floor of a quotient of whole numbers, which // would cut towards zero
        mean = "list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j)"
        tables.append(f"a{r} AS MATERIALIZED ({label.format(r=r - 1)})")
        tables.append(f"m{r} AS MATERIALIZED (SELECT c, {mean} AS q FROM (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT m.c AS c, unnest(q) AS x, unnest(range({dims})) AS j FROM a{r}) u GROUP BY c, j) g GROUP BY c)")
        tables.append(f"c{r} AS MATERIALIZED (SELECT o.c, coalesce(m{r}.q, o.q) AS q FROM c{r - 1} o LEFT JOIN m{r} ON m{r}.c = o.c)")
    tables.append(f"z AS MATERIALIZED ({label.format(r=rounds)})")
    return f"""
        WITH {", ".join(tables)}
        SELECT z.vec_id, CAST(z.m.c AS INT) AS cluster, z.m.d AS distance, CAST(sum(z.m.d) OVER (PARTITION BY z.m.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(z.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.q, ',')) AS centroid_sha256
        FROM z JOIN c{rounds} f ON f.c = z.m.c"""
