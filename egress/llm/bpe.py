"""Exact BPE by per-prefix dynamic programming.

For every prefix of a pre-token there is exactly one token that ends the prefix's encoding:
the one that matches a suffix of the prefix and that BPE would leave side by side with the
last token of what precedes it. An Aho-Corasick automaton over the vocabulary lists the
tokens that end at each byte; a pair test undoes merges on either side of the border. Back
pointers then give the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries per worker process; bounds memory.
CACHED = 500_000
#: The fixed pattern of byte-level pre-tokens.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: White space next to a blank or at either end: there, chunks between blanks depend on their neighbours.
_UNEVEN = regex.compile(r" \s|\s |^\s|\s$")
_NEVER = 1 << 40


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 as itself, the others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_of_letter()
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        #: For each token the rank of the merge that makes it (-1: a byte) and its two parts.
        self.made, self.parts = [-1] * len(self.bytes_of), [(-1, -1)] * len(self.bytes_of)
        for (a, b), k in self.rank.items():
            i = vocab["".join(merges[k])]
            self.made[i], self.parts[i] = k, (a, b)
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            if self.made[i] >= 0 or len(self.bytes_of[i]) == 1:
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.inner, self.spaced = _Chunks(self, ""), _Chunks(self, " ")
        self.pre: dict[str, bytes] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side.

        Undoes, latest first, the merges that made the tokens at the border. Between two
        merges the border's neighbours are (a, b); a rule for that pair would have been
        applied if it ranks before both of their own merges, or ties with the right one,
        as equal rules go from left to right.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, made, parts = self.rank, self.made, self.parts
        until_a = until_b = _NEVER
        out = True
        while True:
            r = rank.get((a, b))
            if r is not None and r < until_a and r <= until_b:
                out = False
                break
            if made[a] < 0 and made[b] < 0:
                break
            if made[a] > made[b]:
                until_a, a = made[a], parts[a][1]
            else:
                until_b, b = made[b], parts[b][0]
        if len(self.pairs) >= CACHED:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def pre_token(self, text: str) -> bytes:
        """Ids of one pre-token as little-endian uint32."""
        known = self.pre.get(text)
        if known is not None:
            return known
        raw = text.encode()
        last: list[int] = [-1] * (len(raw) + 1)
        size: list[int] = [0] * (len(raw) + 1)
        for end, (n, token) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if n > size[end]:  # of the tokens that end here exactly one fits
                start = end - n
                if start == 0 or last[start] >= 0 and self.apart(last[start], token):
                    last[end], size[end] = token, n
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= size[at]
        out = np.array(ids[::-1], "<u4").tobytes()
        if len(raw) <= 64:
            if len(self.pre) >= CACHED:
                self.pre.clear()
            self.pre[text] = out
        return out

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNEVEN.search(text):
            return b"".join(map(self.pre_token, PATTERN.findall(text)))
        first, *rest = text.split(" ")
        return self.inner[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32; special tokens' strings become their ids, as in the library."""
        if self.special_split is None or not any(s in text for s in self.specials):
            return self._plain(text)
        return b"".join(np.array([self.specials[x]], "<u4").tobytes() if x in self.specials else self._plain(x) for x in self.special_split.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Chunks(dict):
    """Ids of the pieces between blanks (with or without the blank before them): pre-tokens never reach over a single blank."""

    def __init__(self, bpe: Bpe, before: str):
        self.bpe, self.before = bpe, before

    def __missing__(self, chunk: str) -> bytes:
        out = b"".join(map(self.bpe.pre_token, PATTERN.findall(self.before + chunk)))
        if len(chunk) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = out
        return out


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One encoder per vocabulary in a worker process; its caches outlive the task."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_column(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>), decoded text of every row; null texts are empty, other columns are not read. Repeated rows are each encoded; an empty table gives an empty result; a text of any length is encoded whole, run by run between its split points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            blobs = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(b) // 4 for b in blobs)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(map(bpe.decode, blobs), pa.string())], names=["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (null: empty), one row for each input row.

    Digests are made where the ids are, so neither ids nor texts move. Repeated rows are each
    told; an empty table gives an empty result; a text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            blobs = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(b) // 4 for b in blobs], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in blobs], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(b).encode()).hexdigest() for b in blobs], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
