"""Exact dedup against immutable snapshots screened by binary-fuse filters.

A snapshot is a bucket table (one row per distinct digest, with the bytes that the digest
stands for) and static 3-wise binary-fuse filters, one per digest shard, each over a bounded
number of keys. A new batch is first grouped by digest on its own (map-side combine, so a
text that fills a third of the batch is one row per task); its distinct digests are then
screened by the filters, a shard's filter being copied to as many tasks as bound its
digests, and only positives join the snapshot's buckets for byte checks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.llm.store import fold_of, written

#: The fixed set of characters that don't count: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 500_000
LEAST_SHARDS = 256


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


# --- binary-fuse filter over 64-bit keys -------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit finaliser of splitmix (fixed constants), keyed by a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots in three neighbouring segments for each key."""
    first = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    lo, mask = hashes & np.uint64(0xFFFFFFFF), np.uint64(segment - 1)
    base = first * np.uint64(segment)
    return np.stack([base + (lo & mask), base + np.uint64(segment) + ((lo >> np.uint64(11)) & mask), base + np.uint64(2 * segment) + ((hashes >> np.uint64(17)) & mask)]).astype(np.int64)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def build_fuse(keys: np.ndarray, tries: int = 64) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, 16-bit table) with no false negative; peels in rounds, all lonely slots at once."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return 0, 0, 0, b""
    segment = 1 << max(2, min(11, int(np.log2(max(n, 4)) * 0.65)))
    for seed in range(1, tries + 1):
        slack = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) * (1 + seed / 16)
        segments = max(1, int(np.ceil(n * slack / segment)) - 2)
        hashes = _mix(keys, seed)
        slots = _slots(hashes, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        xor = np.zeros(size, np.int64)
        index = np.arange(n)
        for row in slots:
            np.bitwise_xor.at(xor, row, index)
        order: list[tuple[np.ndarray, np.ndarray]] = []
        done = 0
        while True:
            lonely = np.flatnonzero(count == 1)
            if not len(lonely):
                break
            owner, pick = np.unique(xor[lonely], return_index=True)
            at = lonely[pick]
            order.append((owner, at))
            done += len(owner)
            for row in slots[:, owner]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(xor, row, owner)
        if done == n:
            table, marks = np.zeros(size, np.uint16), _prints(hashes)
            for owner, at in reversed(order):
                a, b, c = slots[:, owner]
                table[at] = 0
                table[at] = marks[owner] ^ table[a] ^ table[b] ^ table[c]
            return seed, segment, segments, table.tobytes()
    raise RuntimeError("no binary-fuse filter found; keys must be distinct 64-bit hashes")


def in_fuse(keys: np.ndarray, built: tuple[int, int, int, bytes]) -> np.ndarray:
    seed, segment, segments, blob = built
    if not blob:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint16)
    hashes = _mix(keys, seed)
    a, b, c = _slots(hashes, segment, segments)
    return _prints(hashes) == table[a] ^ table[b] ^ table[c]


# --- snapshots ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """``buckets``: digest, bytes. ``filters``: shard, seed, segment, segments, table."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def digested(df: DataFrame, id_col: str, text_col: str, digest_bits: int = 256, *more: Column) -> DataFrame:
    """id, n_chars, text_sha256, digest, bytes (normalised text). Fewer ``digest_bits`` than 256 only serve tests of clashing digests."""
    return (
        df.select(F.col(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), normalised(F.col(text_col)).alias("bytes"), *more)
        .withColumn("text_sha256", F.sha2("bytes", 256))
        .withColumn("digest", F.substring("text_sha256", 1, digest_bits // 4))
    )


def buckets_of(rows: DataFrame, *more: str) -> DataFrame:
    """One row per digest with the least of its bytes, and the greatest if they differ, which means that digests clash. Partial aggregation folds copies in the reading task."""
    return rows.groupBy(*more, "digest").agg(F.min("bytes").alias("bytes"), F.nullif(F.max("bytes"), F.min("bytes")).alias("other"))


def _best() -> Column:
    return F.max(F.struct("n_chars", (-F.col("id")).alias("less"), (-F.col("row")).alias("less_row"), "id", "row")).alias("best")


def _build(table: pa.Table) -> pa.Table:
    seed, segment, segments, blob = build_fuse(table.column("key").to_numpy())
    return pa.table({"shard": table.column("shard").slice(0, 1), "seed": pa.array([seed], pa.int32()), "segment": pa.array([segment], pa.int32()), "segments": pa.array([segments], pa.int32()), "table": pa.array([blob], pa.binary())})


def _screen(rows: pa.Table, filters: pa.Table) -> pa.Table:
    if filters.num_rows and rows.num_rows:
        f = filters.slice(0, 1).to_pylist()[0]
        hit = in_fuse(rows.column("key").to_numpy(), (f["seed"], f["segment"], f["segments"], f["table"]))
    else:
        hit = np.zeros(rows.num_rows, bool)
    return pa.table({"digest": rows.column("digest").filter(pa.array(hit))})


def _keyed(digests: DataFrame, shards: int) -> DataFrame:
    return digests.select("digest", F.xxhash64("digest").alias("key")).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))


def build_snapshot(buckets: DataFrame) -> Snapshot:
    """Snapshot of a bucket table (one row per digest). Shards grow with the number of keys, so that each filter is bounded."""
    shards = max(LEAST_SHARDS, -(-buckets.count() // KEYS_PER_SHARD))
    filters = _keyed(buckets, shards).groupBy("shard").applyInArrow(_build, "shard int, seed int, segment int, segments int, table binary")
    return Snapshot(buckets, written(filters, "fuse-filters"), shards)


def screen(digests: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Digests that the snapshot's filters may hold: all that it holds, and about 1 in 65,536 others. A task screens some KEYS_PER_SHARD digests at most, however small the snapshot is against them."""
    parts = -(-digests.count() // (snapshot.shards * KEYS_PER_SHARD)) or 1
    keyed = _keyed(digests, snapshot.shards).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    filters = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return keyed.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(_screen, "digest string")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_snapshot: Column | None = None, digest_bits: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chars (code points).

    Texts are equal when equal without ASCII white space. The row with the most code points,
    then the smallest id, stays; of fully repeated rows one stays. ``in_snapshot`` tells the
    rows of the older, immutable part (by default half of the ids); the others are the new
    batch. Null texts are empty, empty texts form a group like any other, null ids come last
    among ties, an empty table gives an empty result. A very long text is one row, whole.
    Other columns are not read.
    """
    old = F.coalesce(fold_of(id_col, 2) == 0 if in_snapshot is None else in_snapshot, F.lit(False)).alias("old")
    texts = digested(df, id_col, text_col, digest_bits, old)
    rows = written(texts.drop("bytes").withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    buckets = written(buckets_of(texts, "old"), "dedup-buckets")
    stored, fresh = buckets.filter("old").drop("old"), buckets.filter("not old").drop("old")

    snapshot = build_snapshot(stored.drop("other"))
    positives = screen(fresh, snapshot).join(fresh.select("digest", F.col("bytes").alias("new_bytes")), "digest")
    checked = written(positives.join(snapshot.buckets, "digest").select("digest", (F.col("new_bytes") == F.col("bytes")).alias("same")), "dedup-checked")
    clashing = buckets.filter("other IS NOT NULL").select("digest").union(checked.filter("not same").select("digest")).distinct()

    groups = rows.groupBy("old", "digest").agg(_best(), F.count("*").alias("size"))
    # A byte-checked digest of the batch falls to the snapshot's group, any other is a group of the batch.
    owner = groups.join(checked.filter("same").select("digest", F.lit(True).alias("seen")), "digest", "left")
    own = F.col("old") | F.coalesce("seen", F.lit(False))
    merged = owner.groupBy("digest", own.alias("own")).agg(F.max("best").alias("best"), F.sum("size").alias("group_size")).drop("own")
    out = _told(rows, merged, ["digest"], id_col)
    if clashing.isEmpty():
        return out
    # Different texts under one digest: these rows alone are grouped by their bytes.
    some = written(texts.join(clashing, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "dedup-clashes")
    exact = some.groupBy("digest", "bytes").agg(_best(), F.count("*").alias("group_size"))
    return _told(rows.join(clashing, "digest", "left_anti"), merged, ["digest"], id_col).unionByName(_told(some, exact, ["digest", "bytes"], id_col))


def _told(rows: DataFrame, groups: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Rows with their group's decision. A hot key is split by adaptive execution: nothing above the join needs a key's rows together."""
    told = rows.join(groups.select(*keys, "best", "group_size"), keys)
    return told.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "n_chars")


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all columns, whatever their names; of rows that repeat an id and a text one stays. Null and empty texts are one group; an empty table stays empty."""
    kept = dedup(df, id_col, text_col).filter("kept").select(F.col(id_col).alias("kept_id"), F.col("n_chars").alias("kept_n"), F.col("text_sha256").alias("kept_sha"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n"), F.sha2(normalised(text), 256).alias("sha"))
    same = rows["id"].eqNullSafe(kept["kept_id"]) & (rows["n"] == kept["kept_n"]) & (rows["sha"] == kept["kept_sha"])
    return rows.join(kept.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["id", "n", "sha"]).select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
