"""Global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.plans.store import shuffle_parts, written

_LOCAL = (1 << 33) - 1


def ranked(df: DataFrame, *order: Column | str, name: str = "rnk") -> DataFrame:
    """``df`` with ``name``: the row's place (from 0) in the given total order. A column of that name is replaced; others stay, whatever their names.

    Rows are range-partitioned and sorted; each partition numbers its own rows, and the
    sizes of earlier partitions (one number for each) shift them. Rows equal in all keys
    may take either place.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    local = written(placed.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "ranks")
    part = F.shiftrightunsigned("id", 33).cast("int")
    sizes = local.groupBy(part.alias("part")).count().collect()
    shifts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        shifts.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(shifts, "part int, shift long")
    numbered = local.withColumn("part", part).join(F.broadcast(offsets), "part")
    rank = F.col("id").bitwiseAND(F.lit(_LOCAL)) + F.col("shift")
    return numbered.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != name], rank.alias(name))
