"""Token-id files: Parquet list columns in ascending id order, for selective reads.

Texts are range-partitioned by id, so each file holds a run of ids; token lists are
dictionary encoded (delta encoded where a dictionary would not pay), row groups and pages
are bounded and pages are indexed, so that a reader can take a few documents or only the
narrow metadata columns.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from egress.llm.store import new_path, shuffle_parts

#: Words kept per worker process; the memory bound of the encoder.
CACHED_WORDS = 600_000
FILE_SCHEMA = "doc_id long, n_tokens int, part int, part_start long, ids array<int>"
#: Format settings: version 2 pages carry delta encodings, column and offset indexes are always written.
WRITER = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "compression": "zstd"}


class WordIds(dict):
    """Bytes of a lower-cased chunk without ASCII white space -> its ids as little-endian uint32.

    The tokenizer drops white space, lower-cases, and never merges over white space, so a
    chunk's ids don't depend on its neighbours. The library encodes each distinct chunk once.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        self.model = self.library.model
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        stem = chunk.rstrip(b".,")
        if stem != chunk and stem and len(chunk) - len(stem) == 1 and _plain(stem):
            out = self[stem] + self[chunk[-1:]]
        elif _plain(chunk):
            # One run of Latin letters below U+0250: already normal, one pre-token, so the model alone decides.
            word = chunk.decode().lower().encode()
            out = np.array([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word)))], "<u4").tobytes()
        else:
            out = self.encode(chunk.decode())
        self[chunk] = out
        return out

    def of(self, text: str) -> bytes:
        raw = text.encode()
        if any(x[:2] in raw for x in self.specials):
            return self.encode(text)  # a special token's string must keep its case
        return b"".join(map(self.__getitem__, raw.lower().split()))


def _plain(chunk: bytes) -> bool:
    word = chunk.decode()
    return word.isalpha() and max(word) < "ɐ" and word.lower().isalpha() and unicodedata.is_normalized("NFC", word)


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE shows each byte as: printable Latin-1 as itself, the rest from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_ENCODERS: dict[str, WordIds] = {}


def encoder(tokenizer_path: str) -> WordIds:
    """One encoder for each tokenizer in a worker process; it outlives the task."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = WordIds(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Encodes whole texts (null: empty), each followed by ``end_id``, into files in ascending id order.

    Null ids come first; rows that repeat an id are ordered by text hash and all written. An
    empty table writes files without rows. A text of any length is encoded whole and is one
    list, so it must fit a task. Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, start, part = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), 0, TaskContext.get().partitionId()
        for batch in batches:
            blobs = [words.of(t or "") + end for t in batch.column("text").to_pylist()]
            if not blobs:
                continue
            sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(start + ends - sizes, pa.int64()), ids], names=["doc_id", "n_tokens", "part", "part_start", "ids"])
            start += int(ends[-1])

    keys = ["doc_id", "hash", "row"]
    placed = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(shuffle_parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "text").mapInArrow(encode, FILE_SCHEMA).write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the files; select doc_id and n_tokens alone to read only metadata pages, filter on doc_id to skip row groups and pages."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, part_offset: ids in all earlier files. One row per written file, whatever the rows."""
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        raw = memoryview(values.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("part_start"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Read back from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = T.StructType.fromDDL("doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    rows = read_tokens(spark, path).select("doc_id", "part", "part_start", "ids").mapInArrow(_checked, schema)
    return rows.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("part_start") + F.col("part_offset")).alias("start"), "n_tokens", "ids_crc32")


def token_output(df: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    spark = df.sparkSession
    path = path or new_path(spark, "token-files")
    write_tokens(df, path, tokenizer_path)
    return token_index(spark, path)
