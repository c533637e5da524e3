"""Language-model scores by deleted interpolation of bigram and unigram estimates.

Documents are dealt into blocks. A block asks for each of its distinct n-grams once, with
its own training counts; requests meet by n-gram hash, counts are summed, and the sums go
back to the blocks, where every token gets its counts. Nothing but sorted 64-bit hashes and
counts moves for n-grams, and a frequent n-gram is one entry per block.

The mixture weights depend on how often the context was seen (buckets by powers of two).
They are learned by expectation-maximisation on held-out counts: training documents of one
fold are taken out, and their tokens are predicted from the counts of the others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.llm.store import fold_of, written
from egress.llm.textvec import groups, mixed, word_hashes

FOLDS, TEST_FOLD, WEIGHT_FOLD = 5, 1, 0
BUCKETS = 20
#: Text per block and per shard of n-grams, in characters; a row counts as so many more in a block.
BLOCK_CHARS, SHARD_CHARS, ROW_CHARS = 12 << 20, 8 << 20, 1 << 10
#: Fixed marks of the end and of the start of a text among word hashes, and of bigrams.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0xD1342543DE82EF95)
#: Steps for an octave in the held-out histogram (so an estimate is off by 4.4 % at most), and bits for an estimate's steps; both bound what the driver gets.
STEPS, STEP_BITS = 8, 9
NONE = (1 << STEP_BITS) - 1


# --- n-grams of a block ---------------------------------------------------------------------


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram and bigram hash of every token (words, then an end) of every text, and the tokens of each text."""
    words, counts = [], []
    for piece in groups(texts):
        w, c = word_hashes(texts[piece])
        words.append(np.insert(w, np.cumsum(c), END))
        counts.append(c + 1)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    uni, sizes = np.concatenate(words), np.concatenate(counts)
    before = np.empty_like(uni)
    before[1:] = uni[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return uni, mixed(before * _PAIR + uni), sizes


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps of 6 bytes where they fit, else of 8; the first byte tells which."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    if len(gaps) and int(gaps.max()) < 1 << 48:
        return b"\x06" + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\x08" + gaps.astype("<u8").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if blob[0] == 8:
        return np.cumsum(np.frombuffer(blob, "<u8", offset=1), dtype=np.uint64)
    six = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _planes(counts: np.ndarray) -> bytes:
    """uint32 counts with first bytes first, which compresses well."""
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _counts(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _sent(counts: np.ndarray) -> bytes:
    """Counts as they move: nearly all are 0 or 1, which the shuffle's own codec hardly shrinks."""
    return zlib.compress(_planes(counts), 1)


def _got(blob: bytes) -> np.ndarray:
    return _counts(zlib.decompress(blob))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the high half of the hash, so that sorted keys lie in sorted shards."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


#: A block holds one role of documents: those that give the weights their held-out counts, other training documents, test documents.
HELD, KEPT, TEST = range(3)
REQUESTS = "level int, shard int, block int, keys binary, counts binary"
ANSWERS = "block int, level int, shard int, counts binary, kept binary"
#: kind 0: a document; 1: distinct known unigrams in a shard; 2: cells of a block's held-out histogram.
STREAMS = "kind int, doc_id long, role int, n_tokens long, n_known long, log_sum double, uni binary, bi binary, n_all long, n_kept long, cells array<int>, weights array<long>"


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they move to their block. Null stays null."""
    for batch in batches:
        texts = [None if t is None else zlib.compress(t.encode(), 1) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()), batch.column("block")], names=["doc_id", "text", "block"])


def _texts(table: pa.Table) -> list[str | None]:
    return [None if t is None else zlib.decompress(t).decode() for t in table.column("text").to_pylist()]


def _asks(table: pa.Table, shards: int) -> pa.Table:
    """Distinct n-grams of a block by shard, with the block's counts if it is a training block."""
    block = table.column("block")[0].as_py()
    rows = {n: [] for n in ("level", "shard", "block", "keys", "counts")}
    for level, tokens in enumerate(ngrams(_texts(table))[:2], 1):
        keys, counts = np.unique(tokens, return_counts=True)
        if block % 3 == TEST:
            counts = None
        shard, cuts = np.unique(_shard(keys, shards), return_index=True)  # those asked only, however many there are
        for s, a, b in zip(shard.tolist(), cuts, [*cuts[1:], len(keys)], strict=True):
            for n, v in zip(rows, (level, s, block, _packed(keys[a:b]), None if counts is None else _sent(counts[a:b])), strict=True):
                rows[n].append(v)
    kinds = {"level": pa.int32(), "shard": pa.int32(), "block": pa.int32()}
    return pa.table({n: pa.array(v, kinds.get(n, pa.binary())) for n, v in rows.items()})


def _sums(table: pa.Table) -> pa.Table:
    """Answers to all blocks that asked a shard, in the order of their keys: all training counts, and to blocks of held-out counts those of the other documents. Block -1 gets the number of distinct n-grams seen in training."""
    blocks = table.column("block").to_pylist()
    keys = [_unpacked(b) for b in table.column("keys").to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total, kept = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    places = [place[e - len(k) : e] for e, k in zip(ends, keys, strict=True)]
    for block, own, blob in zip(blocks, places, table.column("counts").to_pylist(), strict=True):
        if blob is not None:
            total[own] += _got(blob)  # a block's keys are distinct
            if block % 3 == KEPT:
                kept[own] += _got(blob)
    seen = [_sent(np.array([np.count_nonzero(x)])) for x in (total, kept)]
    counts = [*(_sent(total[own]) for own in places), seen[0]]
    kepts = [*(_sent(kept[own]) if block % 3 == HELD else None for block, own in zip(blocks, places, strict=True)), seen[1]]
    level, shard = table.column("level")[0].as_py(), table.column("shard")[0].as_py()
    same = [pa.array([v] * len(counts), pa.int32()) for v in (level, shard)]
    return pa.table([pa.array([*blocks, -1], pa.int32()), *same, pa.array(counts, pa.binary()), pa.array(kepts, pa.binary())], names=["block", "level", "shard", "counts", "kept"])


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2(count)), at most BUCKETS - 1."""
    return np.minimum(np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0), BUCKETS - 1).astype(np.int64)


def _contexts(uni: np.ndarray, sizes: np.ndarray, texts: float) -> np.ndarray:
    """How often each token's context was seen: the count of the word before it, or of texts at a start."""
    before = np.empty(len(uni), np.float64)
    before[1:] = uni[:-1]
    before[np.cumsum(sizes) - sizes] = texts
    return before


def _cells(uni: np.ndarray, bi: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histogram cells of held-out tokens: context bucket, and the log of both estimates in steps (NONE: zero)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(bi > 0, np.minimum(NONE - 1, np.rint(-STEPS * np.log2(bi / np.maximum(context, 1)))), NONE).astype(np.int64)
        one = np.where(uni > 0, np.minimum(NONE - 1, np.rint(STEPS * np.log2(np.maximum(uni, 1)))), NONE).astype(np.int64)
    return np.unique(bucket_of(context) << 2 * STEP_BITS | np.maximum(two, 0) << STEP_BITS | one, return_counts=True)


def _streamed(docs: pa.Table, answers: pa.Table, shards: int, kept_texts: int) -> pa.Table:
    """Every document of a block with its tokens' counts, and the block's held-out histogram."""
    names = [f.split()[0] for f in STREAMS.split(", ")]
    rows: list[dict] = []
    got = {(a["level"], a["shard"]): a for a in answers.to_pylist()}
    if not docs.num_rows:  # block -1
        for (level, _), a in got.items():
            if level == 1:
                rows.append({"kind": 1, "n_all": int(_got(a["counts"])[0]), "n_kept": int(_got(a["kept"])[0])})
    else:
        role, ids = docs.column("block")[0].as_py() % 3, docs.column("doc_id").to_pylist()
        *levels, sizes = ngrams(_texts(docs))
        found: dict[str, list[np.ndarray]] = {"counts": [], "kept": []}
        for level in (1, 2):
            keys, place = np.unique(levels[level - 1], return_inverse=True)
            levels[level - 1] = None
            asked = np.unique(_shard(keys, shards))
            for name in ("counts", "kept") if role == HELD else ("counts",):
                sums = np.concatenate([_got(got[level, int(s)][name]) for s in asked])
                if len(sums) != len(keys):
                    raise ValueError("answers don't fit the block's n-grams")
                found[name].append(sums[place])
            del keys, place, sums
        del got
        uni, bi = found["counts"]
        ends = np.cumsum(sizes)
        logs = np.log10(uni + 0.5)
        for k, (e, n) in enumerate(zip(ends, sizes, strict=True)):
            own = slice(e - n, e)
            rows.append({"kind": 0, "doc_id": ids[k], "role": role, "n_tokens": int(n), "n_known": int(np.count_nonzero(uni[own])), "log_sum": math.fsum(logs[own]), "uni": _planes(uni[own]), "bi": _planes(bi[own])})
        if role == HELD:
            uni_kept, bi_kept = found["kept"]
            cells, weights = _cells(uni_kept, bi_kept, _contexts(uni_kept, sizes, kept_texts))
            rows.append({"kind": 2, "cells": cells.tolist(), "weights": weights.tolist()})
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)


# --- mixture weights -------------------------------------------------------------------------


def learn_weights(cells: np.ndarray, counts: np.ndarray, tokens: int, words: int, rounds: int = 200) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform estimates, by EM on held-out counts in each context bucket."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    uniform = 1.0 / (words + 1)
    for b in range(BUCKETS):
        own = (cells >> 2 * STEP_BITS) == b
        if not own.any() or not counts[own].sum():
            if b:
                weights[b] = weights[b - 1]
            continue
        two, one, n = (cells[own] >> STEP_BITS) & NONE, cells[own] & NONE, counts[own].astype(float)
        parts = np.stack([np.where(two == NONE, 0.0, 2.0 ** (-two / STEPS)), np.where(one == NONE, 0.0, 2.0 ** (one / STEPS) / max(tokens, 1)), np.full(len(n), uniform)])
        mix = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = mix[:, None] * parts
            share /= share.sum(axis=0)
            new = (share * n).sum(axis=1) / n.sum()
            if np.abs(new - mix).max() < 1e-9:
                break
            mix = new
        weights[b] = 0.999 * mix + 0.001 * np.array([0.0, 0.0, 1.0])  # no word is impossible
    return weights


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: Column | None = None, block_chars: int = BLOCK_CHARS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``fold`` (0 to 4) of a row: 1 is held out of training; 0 gives the mixture weights their
    held-out counts. Null texts are empty: one end token. Repeated rows count and are scored
    one by one; an empty table gives an empty result. Without training rows, weights fall back
    to nearly all for the unigrams. A text of any length is counted and scored whole, in a
    block of its own if it is longer than one. Other columns are not read.
    """
    fold_col = fold_of(id_col, FOLDS) if fold is None else fold
    role = F.when(fold_col == TEST_FOLD, TEST).when(fold_col == WEIGHT_FOLD, HELD).otherwise(KEPT)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), role.alias("role"))
    sizes = {r["role"]: r for r in rows.groupBy("role").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"), F.count("*").alias("n")).collect()}
    chars = {k: r["chars"] + 8 * r["n"] for k, r in sizes.items()}
    texts = {k: r["n"] for k, r in sizes.items()}
    shards = -(-sum(chars.values()) // shard_chars) or 1
    kept_texts, train_texts = texts.get(KEPT, 0), texts.get(KEPT, 0) + texts.get(HELD, 0)
    weight = {k: chars[k] + ROW_CHARS * texts[k] for k in chars}
    blocks = F.element_at(F.create_map(*[F.lit(x) for k in range(3) for x in (k, -(-weight.get(k, 0) // block_chars) or 1)]), F.col("role"))
    dealt = rows.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), blocks) * 3 + F.col("role")).cast("int").alias("block"))
    dealt = dealt.mapInArrow(_squeezed, "doc_id long, text binary, block int")

    def asks(table: pa.Table) -> pa.Table:
        return _asks(table, shards)

    def streamed(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return _streamed(docs, answers, shards, kept_texts)

    answers = dealt.groupBy("block").applyInArrow(asks, REQUESTS).groupBy("level", "shard").applyInArrow(_sums, ANSWERS)
    streams = written(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(streamed, STREAMS), "lm-streams", compression="zstd")

    told = streams.agg(
        F.sum(F.when(F.col("role") != TEST, F.col("n_tokens"))).alias("tokens"),
        F.sum(F.when(F.col("role") == KEPT, F.col("n_tokens"))).alias("kept_tokens"),
        F.sum("n_all").alias("words"),
        F.sum("n_kept").alias("kept_words"),
    ).first()
    tokens, words = told["tokens"] or 0, told["words"] or 0
    pairs = streams.filter("kind = 2").select(F.explode(F.arrays_zip("cells", "weights")).alias("x")).groupBy("x.cells").agg(F.sum("x.weights").alias("n")).toArrow()  # 20 x 2^18 pairs of numbers at most, no Python objects
    cells, counts = (pairs.column(c).to_numpy().astype(np.int64) for c in ("cells", "n"))
    mix = learn_weights(cells, counts, told["kept_tokens"] or 0, told["kept_words"] or 0)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uniform = 1.0 / (words + 1)
        for batch in batches:
            scores = []
            for uni_blob, bi_blob in zip(batch.column("uni").to_pylist(), batch.column("bi").to_pylist(), strict=True):
                uni, bi = _counts(uni_blob).astype(float), _counts(bi_blob).astype(float)
                context = _contexts(uni, np.array([len(uni)]), train_texts)
                w = mix[bucket_of(context)]
                p = w[:, 0] * bi / np.maximum(context, 1) + w[:, 1] * uni / max(tokens, 1) + w[:, 2] * uniform
                scores.append(float(np.log10(p).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "role", "n_tokens", "n_known", "log_sum")), pa.array(scores, pa.float64())], names=["doc_id", "role", "n_tokens", "n_known", "log_sum", "score"])

    docs = streams.filter("kind = 0").select("doc_id", "role", "n_tokens", "n_known", "log_sum", "uni", "bi")
    done = docs.mapInArrow(finish, "doc_id long, role int, n_tokens long, n_known long, log_sum double, score double")
    floor = math.log10(tokens + 0.5 * (words + 1))
    return done.select(
        F.col("doc_id").alias(id_col),
        (F.col("role") == TEST).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
