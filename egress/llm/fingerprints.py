"""Document fingerprints: bottom-k sketches of word-shingle hashes.

The k smallest distinct 64-bit shingle hashes of a text. Sketches of parts merge into the
sketch of the whole, and two sketches estimate resemblance, containment and the number of
distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.llm.store import shuffle_parts
from egress.llm.textvec import groups, shingle_hashes, word_hashes

K = 128
WIDTH = 5


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    if len(hashes) > 4 * k:
        part = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def _distinct(s: np.ndarray, k: int) -> float:
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / 2.0**64)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else (k - 1) / the k-th smallest hash as a share of the range."""
    return _distinct(a, k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's bottom k that both have; 1 for two empty sketches."""
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean()) if len(both) else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has, from resemblance and the estimated counts; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * _distinct(merge(a, b, k), k) / _distinct(a, k))


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def sketches(texts: list[str | None], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    out = []
    for piece in groups(texts):
        hashes, counts = shingle_hashes(*word_hashes(texts[piece]), width)
        ends = np.cumsum(counts)
        out += [bottom(hashes[e - n : e], k) for e, n in zip(ends, counts, strict=True)]
    return out


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """id, fingerprint of each row. Null and empty texts have the empty sketch; short texts are one shingle; very long ones are sketched whole. Repeated rows are each sketched; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(to_text, sketches(batch.column(1).to_pylist(), k, width)), pa.string())], names=["id", "fingerprint"])

    ids = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def merge_fingerprints(df: DataFrame, key: str, k: int = K) -> DataFrame:
    """key, fingerprint of all parts of each key; null fingerprints are empty, a null key is a key.

    Sketches fold in three steps, so a key with a third of the parts is never gathered in
    one task: inside each task, then by key and 64 salts, then by key.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, salt int, fingerprint string"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for own, salt, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[own, salt] = merge(held.get((own, salt), np.zeros(0, "<u8")), from_text(text or ""), k)
                if len(held) >= 50_000:
                    yield told(held, kind)
                    held = {}
        if held:
            yield told(held, kind)

    def told(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        keys, salts = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(salts, pa.int32()), pa.array(map(to_text, held.values()), pa.string())], names=["key", "salt", "fingerprint"])

    def fold(table: pa.Table) -> pa.Table:
        held = np.zeros(0, "<u8")
        for text in table.column("fingerprint").to_pylist():
            held = merge(held, from_text(text), k)
        return pa.table([table.column("key").slice(0, 1), table.column("salt").slice(0, 1), pa.array([to_text(held)])], names=["key", "salt", "fingerprint"])

    parts = df.select(F.col(key).alias("key"), (F.spark_partition_id() % 64).alias("salt"), "fingerprint").mapInArrow(partial, schema)
    salted = parts.groupBy("key", "salt").applyInArrow(fold, schema)
    return salted.groupBy("key").applyInArrow(fold, schema).select(F.col("key").alias(key), "fingerprint")


# --- each text against its edited form and its successor -------------------------------------


def _bucket(value: Column, bounds: list[int]) -> Column:
    """Number of bounds <= value, in two steps of about the root of their number each; null has 0."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    low = lambda b: b <= value
    run = F.greatest(F.size(F.filter(F.array(*[F.lit(r[0]) for r in runs]), low)) - 1, F.lit(0))
    inner = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, r)) for r in runs]), run), low))
    return F.when(value.isNull(), F.lit(0)).otherwise((run * step + inner).cast("int"))


def with_successor(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in runs by ascending id; each run ends with a copy (``own`` false) of the row that follows it.

    Texts move once. Bounds between runs are quantiles of the ids, and only the first row of
    each run is sent twice. Rows that repeat an id share a run, ordered by text hash.
    """
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    cuts = ids.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    bounds = sorted({int(c) for c in cuts})
    found = ids.groupBy(_bucket(F.col("id"), bounds).alias("bucket")).agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()
    runs = sorted((r["bucket"], None if r["nulls"] else r["first"]) for r in found)
    before = [(first, runs[k - 1][0], k == 0) for k, (_, first) in enumerate(runs)]
    heads = spark.createDataFrame(before, "head_id long, to_bucket int, wraps boolean")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"bucket": _bucket(F.col("id"), bounds), "hash": F.xxhash64("text")})
    sent = rows.join(F.broadcast(heads), rows["id"].eqNullSafe(heads["head_id"]), "left").withColumn(
        "dest",
        F.explode(F.when(F.col("to_bucket").isNull(), F.array(F.struct("bucket", F.lit(True).alias("own")))).otherwise(F.array(F.struct("bucket", F.lit(True).alias("own")), F.struct(F.col("to_bucket").alias("bucket"), F.lit(False).alias("own"))))),
    )
    placed = sent.select(F.col("dest.bucket").alias("bucket"), (~F.col("dest.own")).alias("foreign"), "id", "hash", "text")
    return placed.repartitionById(max(parts, len(bounds) + 1), F.col("bucket")).sortWithinPartitions("bucket", "foreign", "id", "hash")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(df: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each text against the text whose last half comes from its successor, and against the successor.

    Null texts are empty; two empty sketches have likeness 1; null ids come first, and the
    order goes round; an empty table gives an empty result. Rows that repeat an id follow each
    other in order of their texts and are each told. Texts of any length are compared whole. Other columns are not read.
    """
    rows = with_successor(df)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
        """(ids, texts, successors), a few megabytes at a time."""
        held = None
        done = False
        for batch in batches:
            ids, texts, own, last = [], [], [], []
            for bucket, foreign, i, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "foreign", "id", "text")), strict=True):
                if held is not None and (held[0] == bucket) and not done:
                    ids.append(held[1]), texts.append(held[2]), own.append(text)
                done = foreign
                held = (bucket, i, text)
            for piece in groups(texts):
                yield ids[piece], texts[piece], own[piece]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, after in pairs(batches):
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
            own, changed = sketches(texts, k, width), sketches(edited, k, width)
            # texts come in order, so a successor's sketch is mostly the next row's own
            known = {i: s for i, s in enumerate(own[1:]) if after[i] is texts[i + 1] or after[i] == texts[i + 1]}
            missing = [i for i in range(len(texts)) if i not in known]
            known |= dict(zip(missing, sketches([after[i] for i in missing], k, width), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array(map(to_text, own), pa.string()),
                    pa.array(map(to_text, changed), pa.string()),
                    pa.array([resemblance(a, b, k) for a, b in zip(own, changed, strict=True)], pa.float64()),
                    pa.array([resemblance(a, known[i], k) for i, a in enumerate(own)], pa.float64()),
                ],
                names=SCHEMA.replace(",", " ").split()[::2],
            )

    return rows.mapInArrow(run, SCHEMA)
