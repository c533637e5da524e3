"""Optimal length buckets and token-budget batches.

A global histogram of sequence lengths goes through a dynamic programme that picks at most
``n_buckets`` padded lengths with the least total padding. Inside a bucket, sequences in
(id) order form batches of ``token_budget // padded length`` sequences.

The histogram has at most ``token_budget`` entries however large the corpus is: a sequence
longer than the budget can share a batch with nothing and gets a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from egress.llm.store import shuffle_parts, written

TOKEN_BUDGET = 16_384
N_BUCKETS = 16


def word_count(text: str) -> Column:
    """Words between ASCII white space, and one end token; null text counts as empty."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def best_boundaries(lengths: Sequence[int], counts: Sequence[int], n_buckets: int) -> list[int]:
    """Padded lengths (ascending) that minimise total padding with at most ``n_buckets`` buckets.

    cost(i, j) = L_j (C_j - C_i) - (S_j - S_i) with C, S the running counts and running
    totals, so each layer is a lower envelope of lines queried at growing L_j: O(buckets x
    lengths), in exact integers. Of equal costs, the fewest buckets win.
    """
    size = len(lengths)
    if not size:
        return []
    run_count, run_total = [0], [0]
    for length, count in zip(lengths, counts, strict=True):
        run_count.append(run_count[-1] + count)
        run_total.append(run_total[-1] + count * length)
    best: list[int | None] = [0] + [None] * size
    back: list[list[int]] = []
    costs = []
    for _ in range(min(n_buckets, size)):
        new: list[int | None] = [None] * (size + 1)
        came = [0] * (size + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, start; slopes fall
        at = 0
        for j in range(1, size + 1):
            if best[j - 1] is not None:
                slope, icept = -run_count[j - 1], best[j - 1] + run_total[j - 1]
                while len(hull) - at >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (icept - b1) * (m1 - m2) <= (b2 - b1) * (m1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, icept, j - 1))
            x = lengths[j - 1]
            while len(hull) - at >= 2 and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if len(hull) > at:
                m, b, start = hull[at]
                new[j], came[j] = m * x + b + x * run_count[j] - run_total[j], start
        back.append(came)
        costs.append(new[size])
        best = new
    layers = min(range(len(costs)), key=lambda k: (costs[k] is None, costs[k] or 0, k))
    cuts, j = [], size
    for came in reversed(back[: layers + 1]):
        cuts.append(lengths[j - 1])
        j = came[j]
    return cuts[::-1]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and each row's rank in its bucket inside the partition. Rows come sorted by bucket."""
    part = TaskContext.get().partitionId()
    open_bucket, seen = None, 0
    for batch in batches:
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        if not len(bucket):
            continue
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rank = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.r_[starts, len(bucket)]))
        if bucket[0] == open_bucket:
            rank[: starts[1] if len(starts) > 1 else len(rank)] += seen
        open_bucket, seen = bucket[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(bucket), part, np.int32)), pa.array(rank.astype(np.int64))],
            names=[*batch.schema.names, "part", "part_rank"],
        )


def pack(df: DataFrame, id_col: str, length: Column, token_budget: int = TOKEN_BUDGET, n_buckets: int = N_BUCKETS) -> DataFrame:
    """One row per input row: id, n_tokens, bucket, bucket_len, batch_id, slot, padding.

    ``bucket`` counts from 0 by padded length; sequences over ``token_budget`` have bucket
    -1 and padded length = own length. ``batch_id`` is unique over all buckets and dense;
    ``slot`` is the place in the batch. Null lengths count as 0, null ids sort first, rows
    that repeat an id are packed one by one, an empty table gives an empty result. Only the
    id and the length are read, so other columns may have any name.
    """
    spark = df.sparkSession
    seqs = written(
        df.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")).withColumn("row", F.monotonically_increasing_id()),
        "packing-lengths",
    )
    histogram = {r["n_tokens"]: r["count"] for r in seqs.filter(F.col("n_tokens") <= token_budget).groupBy("n_tokens").count().collect()}
    lengths = sorted(histogram)
    cuts = best_boundaries(lengths, [histogram[x] for x in lengths], n_buckets)
    bucket = F.when(F.col("n_tokens") > token_budget, F.lit(-1))
    for k, cut in enumerate(cuts):
        bucket = bucket.when(F.col("n_tokens") <= cut, F.lit(k))
    placed = seqs.withColumn("bucket", bucket.cast("int"))
    schema = T.StructType([*placed.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("part_rank", T.LongType())])
    keys = ["bucket", "id", "n_tokens", "row"]
    ranked = written(placed.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_numbered, schema), "packing-ranks")

    # Range partitions hold rising keys, so earlier partitions' counts shift the ranks. One entry for each partition and bucket.
    shifts, totals = [], dict.fromkeys(range(-1, len(cuts)), 0)
    for r in sorted(ranked.groupBy("part", "bucket").count().collect(), key=lambda r: (r["part"], r["bucket"])):
        shifts.append((r["part"], r["bucket"], totals[r["bucket"]]))
        totals[r["bucket"]] += r["count"]
    per_batch = {k: max(1, token_budget // max(cut, 1)) for k, cut in enumerate(cuts)} | {-1: 1}
    first, batch_from = 0, {}
    for k in sorted(totals):
        batch_from[k] = first
        first += -(-totals[k] // per_batch[k])
    rows = [(p, b, s, per_batch[b], batch_from[b], cuts[b] if b >= 0 else None) for p, b, s in shifts]
    offsets = spark.createDataFrame(rows, "part int, bucket int, shift long, per_batch long, batch_from long, cut long")
    rank = F.col("part_rank") + F.col("shift")
    bucket_len = F.coalesce("cut", "n_tokens")
    return ranked.join(F.broadcast(offsets), ["part", "bucket"]).select(
        F.col("id").alias(id_col),
        "n_tokens",
        "bucket",
        bucket_len.alias("bucket_len"),
        (F.col("batch_from") + F.floor(rank / F.col("per_batch"))).cast("long").alias("batch_id"),
        (rank % F.col("per_batch")).alias("slot"),
        (bucket_len - F.col("n_tokens")).alias("padding"),
    )
