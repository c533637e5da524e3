"""Benchmark decontamination by suffix arrays of the training texts.

A shard is about a million words of training texts; a task makes the suffix array of each of
its shards and searches all suffixes of the test items in it by binary search, word by word,
so that a suffix ends with its longest verbatim match and the range of the array that holds
all places where it occurs. Where a window of a test item is matched, the words of each place are
hit. Nothing is shuffled: a text stays in the task that reads it, and what comes from a
hot passage is as long as the places where it occurs.

Test items go to the tasks as word hashes, in passes of a bounded number of words each; a
larger test set takes more passes over the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.llm.store import released, written
from egress.llm.textvec import groups, word_hashes

#: Words of a window. An item of fewer words is one window.
WIDTH = 10
#: Words of a shard, and characters that hold about as many.
SHARD, SHARD_CHARS = 1 << 20, 6 << 20
#: Words of the test items in one pass, which reach the driver and every task: 32 MB.
PASS_WORDS = 1 << 22

#: Letters A to Z fall to lower case, what is no digit, letter or non-ASCII byte to a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text."""
    return word_hashes([(t or "").encode().translate(_TABLE).decode() for t in texts])


def suffix_array(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their suffixes, compared up to ``depth`` words; a text's end sorts before any word. ``left``: words from a position to the end of its text.

    Prefix doubling: suffixes ordered by h words are ordered by 2h through the places of the
    suffixes h words on. Only those still tied are sorted again.
    """
    n = len(words)
    order = np.argsort(words)
    new = np.r_[True, words[order[1:]] != words[order[:-1]]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))
    h = 1
    while h < depth and len(slots):
        at = order[slots]
        after = np.where(left[at] > h, rank[np.minimum(at + h, n - 1)], 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key)
        at, key, after = at[by], key[by], after[by]
        new = np.r_[True, key[1:] != key[:-1]]
        order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
        slots = slots[~((new & np.r_[new[1:], True]) | (after == 0))]  # what ends here stays tied
        h *= 2
    return order


@dataclass(frozen=True)
class Items:
    """Test items of one pass: names (None for a null id), words of all in a row, and each item's number of words."""

    names: list[str | None]
    words: np.ndarray
    counts: np.ndarray

    @property
    def item(self) -> np.ndarray:
        """The item of each suffix."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def left(self) -> np.ndarray:
        """Words of each suffix."""
        return np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(self.words))

    def windows(self, width: int) -> np.ndarray:
        """Words of the window that each suffix opens, 0 if it is too short for one."""
        need = np.minimum(self.counts, width)[self.item]
        return np.where(self.left >= need, need, 0)


class Shard:
    """Some texts' words in a row, and their suffix array."""

    def __init__(self, words: np.ndarray, left: np.ndarray, depth: int):
        self.words, self.left = words, left
        self.order = suffix_array(words, left, depth)

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, upper: bool) -> np.ndarray:
        """First place of each range whose suffix has at ``depth`` no smaller (``upper``: a greater) word."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            at = self.order[mid]
            there, want = self.words[np.minimum(at + depth, len(self.words) - 1)], word[open_]
            before = (self.left[at] <= depth) | (there < want) | ((there == want) & upper)
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        return low

    def matches(self, items: Items, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(window, low, high) of the suffixes whose window occurs: its suffix, and the range of the array; then for all suffixes the words of the longest match, and a place in the array where it occurs."""
        size = len(items.words)
        low, high = np.zeros(size, np.int64), np.full(size, len(self.words), np.int64)
        longest, left, found, active, depth = np.zeros(size, np.int64), items.left, [], np.arange(size), 0
        while len(active):
            word = items.words[active + depth]
            a, b = (self._bound(low[active], high[active], depth, word, upper) for upper in (False, True))
            some = a < b
            active, depth = active[some], depth + 1
            low[active], high[active], longest[active] = a[some], b[some], depth
            there = active[windows[active] == depth]
            found.append((there, low[there], high[there]))
            active = active[left[active] > depth]
        one, two, three = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        return one, two, three, longest, low

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of the given ranges, and the range of each."""
        size = high - low
        of = np.repeat(np.arange(len(low)), size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        return self.order[low[of] + step], of


def shards(words: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
    """(shard, text of each of its words, place of each among ``words``). A text longer than a shard is laid in stretches that overlap by ``depth`` - 1 words."""
    size, ends = max(SHARD, 2 * depth), np.cumsum(counts)
    held: list[tuple[int, int, int]] = []

    def made() -> tuple[Shard, np.ndarray, np.ndarray]:
        place = np.concatenate([np.arange(a, b) for _, a, b in held])
        left = np.concatenate([np.arange(b - a, 0, -1) for _, a, b in held])
        text = np.repeat([k for k, _, _ in held], [b - a for _, a, b in held])
        return Shard(words[place], left, depth), text, place

    total = 0
    for k in np.flatnonzero(counts):
        a, end = int(ends[k] - counts[k]), int(ends[k])
        while True:
            b = min(end, a + size)
            if held and total + b - a > size:
                yield made()
                held, total = [], 0
            held.append((int(k), a, b))
            total += b - a
            if b == end:
                break
            a = b - depth + 1
    if held:
        yield made()


def found(texts: list[str | None], items: Items, width: int) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """Of some texts: words of each, whether each word is hit, and each text's items with occurring windows."""
    words, counts = hashed_words(texts)
    hit, named = np.zeros(len(words), bool), [set() for _ in texts]
    if not len(items.words):
        return counts, hit, named
    windows, item = items.windows(width), items.item
    for shard, text, place in shards(words, counts, int(items.counts.max(initial=1))):
        suffix, low, high, _, _ = shard.matches(items, windows)
        if not len(suffix):
            continue
        # equal windows have equal ranges: each range is located once
        key = (low * (len(text) + 1) + high) * (width + 1) + windows[suffix]
        _, one, of = np.unique(key, return_index=True, return_inverse=True)
        at, which = shard.places(low[one], high[one])
        after = at + windows[suffix[one]][which]
        edge = np.bincount(at, minlength=len(text) + 1) - np.bincount(after, minlength=len(text) + 1)
        hit[place[np.cumsum(edge[:-1]) > 0]] = True
        asked: list[set[int]] = [set() for _ in one]
        for r, i in zip(of.tolist(), item[suffix].tolist(), strict=True):
            asked[r].add(i)
        pairs = np.unique(text[at].astype(np.int64) * len(one) + which)
        for t, r in zip((pairs // len(one)).tolist(), (pairs % len(one)).tolist(), strict=True):
            named[t] |= asked[r]
    return counts, hit, named


def test_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", pass_words: int = PASS_WORDS) -> Iterator[Items]:
    """Items with words, in passes of about ``pass_words`` words; one if they all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = hashed_words(batch.column("text").to_pylist())
            parts = np.split(words, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(counts, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["name", "n", "words"])

    rows = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).mapInArrow(run, "name string, n long, words binary")
    table = written(rows.filter("n > 0").distinct(), "test-items")
    passes = max(1, ceil((table.agg(F.sum("n")).first()[0] or 0) / pass_words))
    for k in range(passes):
        own = table.filter(F.pmod(F.xxhash64("name", "words"), F.lit(passes)) == k).collect()
        if own:
            yield Items([r["name"] for r in own], np.frombuffer(b"".join(r["words"] for r in own), np.uint64), np.array([r["n"] for r in own], np.int64))
    released(table)


FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _pass(rows: DataFrame, items: Items, width: int, keep_text: bool) -> DataFrame:
    """``rows`` (row, text, n_words, spans, items) with what one pass finds added; the text goes unless ``keep_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for piece in groups(texts, SHARD_CHARS):
                own = batch.slice(piece.start, len(texts[piece]))
                counts, hit, named = found(texts[piece], items, width)
                starts = np.cumsum(counts) - counts
                for k, spans in enumerate(own.column("spans").to_pylist()):
                    for s in spans:
                        hit[starts[k] + s["start"] : starts[k] + s["end"]] = True
                names = [sorted({items.names[i] for i in own_items} - {None} | set(old)) for own_items, old in zip(named, own.column("items").to_pylist(), strict=True)]
                out = [own.column("row"), pa.array(counts, pa.int64()), _spans(hit, counts), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*out, own.column("text")] if keep_text else out, names=["row", "n_words", "spans", "items", *(["text"] if keep_text else [])])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, {FOUND}" + (", text string" if keep_text else "")
    return rows.mapInArrow(run, schema)


def _spans(hit: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of hit words in each text, as places within it."""
    starts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    first = hit & ~(np.r_[False, hit[:-1]] & np.r_[False, text[1:] == text[:-1]]) if len(hit) else hit
    last = hit & ~(np.r_[hit[1:], False] & np.r_[text[1:] == text[:-1], False]) if len(hit) else hit
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    owner = text[a]
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(counts)))].astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array((a - starts[owner]).astype(np.int32)), pa.array((b + 1 - starts[owner]).astype(np.int32))], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _searched(rows: DataFrame, items: DataFrame, width: int, item_id: str, item_text: str, keep_text: bool, pass_words: int) -> DataFrame:
    """``rows`` (row, text) with n_words, spans and items of all passes."""
    empty = {"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:int,end:int>>"), "items": F.array().cast("array<string>")}
    rows, held, waiting = rows.withColumns(empty), None, None
    for block in test_items(items, item_id, item_text, pass_words):
        if waiting is not None:  # several passes: each is written, so that no plan holds more than one
            last, held = held, written(_pass(rows, waiting, width, True), "decontamination")
            rows = held
            if last is not None:
                released(last)
        waiting = block
    return _pass(rows, waiting or Items([], np.zeros(0, np.uint64), np.zeros(0, np.int64)), width, keep_text)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per input row: id, n_words, spans (start, end in words: what windows of test items cover), items (ids as text, sorted, of items with a window that occurs).

    Words are runs of ASCII digits and letters and of non-ASCII characters, A to Z in lower case. A window is
    ``width`` words in a row of an item; an item with fewer words, but some, is one window.
    Null and empty texts have no words; items without words occur nowhere; an item of null id hits
    words without being named, and an id's rows count as one item. Repeated rows are each told.
    A text of any length is searched whole, in stretches of a million words. Empty tables give an
    empty result, or no hit. Other columns are not read.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    out = _searched(rows, items, width, item_id, item_text, False, pass_words)
    return out.select(F.col("row.id").alias(id_col), "n_words", "spans", "items")


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, in which no window of a test item occurs; nulls, repeats and long texts as in :func:`contamination`."""
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(True).alias("_" * (1 + max(map(len, [*rest, ""]))))).alias("row"), F.col(text_col).alias("text"))
    clean = _searched(rows, items, width, item_id, item_text, True, pass_words).filter(F.size("spans") == 0)
    return clean.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per test item: item (id as text), length (words of its longest verbatim match), item_start (the first of equals), and a place of it: doc_id of the first text of its shard, doc_start.

    Items without a word in common with any text are left out, as are those of null id; of an id's rows the longest
    match is told. A task keeps one row for each item, so what is shuffled is items x tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows, parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for block in test_items(items, item_id, item_text, pass_words):

        def run(batches: Iterator[pa.RecordBatch], items: Items = block) -> Iterator[pa.RecordBatch]:
            item, starts = items.item, np.cumsum(items.counts) - items.counts
            windows, best = np.zeros(len(item), np.int64), {}
            depth = int(items.counts.max(initial=1))
            for batch in batches:
                texts, ids = batch.column("text").to_pylist(), batch.column("id").to_pylist()
                for piece in groups(texts, SHARD_CHARS):
                    words, counts = hashed_words(texts[piece])
                    ends = np.cumsum(counts)
                    for shard, text, place in shards(words, counts, depth):
                        *_, longest, low = shard.matches(items, windows)
                        order = np.lexsort((np.arange(len(item)), -longest, item))
                        first = order[np.r_[True, item[order][1:] != item[order][:-1]]]
                        for s in first[longest[first] > 0].tolist():
                            if longest[s] > best.get(item[s], (0,))[0]:
                                at = int(shard.order[low[s]])
                                t = int(text[at])
                                best[item[s]] = (int(longest[s]), s - int(starts[item[s]]), ids[piece.start + t], int(place[at] - ends[t] + counts[t]))
            told = [(items.names[i], *b) for i, b in best.items() if items.names[i] is not None]
            if told:
                name, length, start, doc, at = (pa.array(c) for c in zip(*told, strict=True))
                yield pa.RecordBatch.from_arrays([name, length, start, doc.cast(batch.schema.field("id").type), at], names=["item", "length", "item_start", "id", "doc_start"])

        part = rows.mapInArrow(run, f"item string, length long, item_start long, id {kind}, doc_start long")
        parts = part if parts is None else parts.union(part)
    if parts is None:
        parts = rows.select(F.lit("").alias("item"), *[F.lit(0).cast("long").alias(c) for c in ("length", "item_start")], "id", F.lit(0).cast("long").alias("doc_start")).limit(0)
    order = F.struct("length", -F.col("item_start"), F.struct("id", "doc_start"))
    best = parts.groupBy("item").agg(F.max_by(F.struct("length", "item_start", "id", "doc_start"), order).alias("m"))
    return best.select("item", "m.length", "m.item_start", F.col("m.id").alias(id_col), "m.doc_start")


def oracle_sql(width: int = WIDTH) -> str:
    """DuckDB SQL: windows of items joined to the word n-grams of documents."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item_id, w, least({width}, len(w)) AS n, unnest(range(1, len(w) - least({width}, len(w)) + 2)) AS k FROM b WHERE len(w) > 0) x),
        g AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) l WHERE len(w) >= n) x),
        h AS (SELECT g.r, g.k, g.n, i.item_id FROM g JOIN i ON i.s = g.s AND i.n = g.n),
        p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) x GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) x GROUP BY r)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN t ON t.r = d.r"""
