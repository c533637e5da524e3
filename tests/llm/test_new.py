"""Decontamination, fill-in-the-middle and centroids against brute force: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from egress.llm import centroids, decontamination, fill_middle

DOCS = "doc_id long, text string, row string, id string, spans string, made string"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", "i", "s", "m") for i, t in zip(ids, texts, strict=True)], DOCS)


# --- decontamination


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, items, width):
    """(words, hit words, names) of each text by sliding over all windows."""
    out = []
    for text in texts:
        words, hit, names = tokens(text), set(), set()
        for name, item in items:
            own = tokens(item)
            n = min(width, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(words) - n + 1 if windows else 0):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= {str(name)} - {"None"}
        out.append((len(words), hit, sorted(names)))
    return out


def some_texts(n, seed, most=40):
    rnd = random.Random(seed)
    vocab = ["a", "b", "Cé", "9", "日本", "dd"]
    return [rnd.choice([" ", ", ", "\n"]).join(rnd.choices(vocab, k=rnd.randint(0, most))) for _ in range(n)]


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(4)
    for depth in (1, 3, 64):
        counts = rnd.integers(1, 30, 40)
        words = rnd.integers(0, 3, counts.sum()).astype(np.uint64)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(counts.sum())
        order = decontamination.suffix_array(words, left, depth)
        suffixes = [tuple(words[k : k + min(left[k], depth)].tolist()) for k in order]
        assert sorted(order.tolist()) == list(range(counts.sum())) and suffixes == sorted(suffixes)


@pytest.mark.parametrize("shard", [8, 50, 1 << 20])
def test_windows_by_brute_force(monkeypatch, shard):
    """Also with texts that are longer than a shard, laid in stretches."""
    monkeypatch.setattr(decontamination, "SHARD", shard)
    texts = [*some_texts(60, 1), None, "", " ,. ", "a " * 300, "a b " * 200, "A. b; cÉ 9 日本"]
    items = [*enumerate(some_texts(12, 2, 14)), (90, "a a a"), (91, "dd"), (92, "a b " * 15), (93, "never seen words"), (None, "b b b b")]
    hashed = [decontamination.hashed_words([t]) for _, t in items]
    some = [k for k, (w, _) in enumerate(hashed) if len(w)]
    block = decontamination.Items([None if items[k][0] is None else str(items[k][0]) for k in some], np.concatenate([hashed[k][0] for k in some]), np.array([len(hashed[k][0]) for k in some]))
    counts, hit, named = decontamination.found(texts, block, 4)
    ends = np.cumsum(counts)
    got = [(int(n), set(np.flatnonzero(hit[e - n : e]).tolist()), sorted({block.names[i] for i in own} - {None})) for n, e, own in zip(counts, ends, named, strict=True)]
    assert got == brute(texts, items, 4)


@pytest.mark.parametrize("pass_words", [20, 1 << 22])
def test_contamination_and_removal(spark, pass_words):
    """In one pass and in several, with repeated rows, a null id, clashing columns."""
    texts = [*some_texts(30, 5), None, "", "x y", "x y", "one two three four five six seven eight nine ten eleven", "Q" * 50_000]
    ids = [*range(34), None, 35]
    items = [(1, "one two three four five six seven eight nine ten"), (2, "X y"), (2, "q" * 50_000), (3, None), (4, " . "), (None, "dd"), (5, "a b a b a b a b a b a b"), (10, "x Y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts, ids).repartition(3)
    want = sorted(((i, n, len(h), names) for i, (n, h, names) in zip(ids, brute(texts, items, 10), strict=True)), key=str)
    found = decontamination.contamination(docs, bench, pass_words=pass_words).withColumn("n_hit", decontamination.n_hit())
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str) == want
    clean = decontamination.decontaminated(docs, bench, pass_words=pass_words)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)


def test_decontamination_of_empty_tables(spark):
    docs, bench = table(spark, ["a b", None]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert [(r.n_words, r.spans, r["items"]) for r in decontamination.contamination(docs, bench.limit(0)).orderBy("doc_id").collect()] == [(2, [], []), (0, [], [])]
    assert decontamination.decontaminated(docs, bench.limit(0)).count() == 2
    assert decontamination.longest_matches(docs, bench.limit(0)).count() == 0


def test_longest_matches(spark):
    docs = table(spark, ["u v w x", "z a b c d e f", "a b c", None], [7, 8, 9, 3])
    bench = spark.createDataFrame([(1, "q a b c d x"), (2, "w X nothing"), (3, "unknown"), (4, None), (None, "u")], "item_id long, text string")
    for pass_words in (3, 1000):
        got = {r.item: (r.length, r.item_start, r.doc_id, r.doc_start) for r in decontamination.longest_matches(docs.coalesce(1), bench, pass_words=pass_words).collect()}
        assert got == {"1": (4, 1, 8, 1), "2": (2, 0, 7, 2)}


# --- fill-in-the-middle

ODD = [None, "", "a", "x<P>y", "<S", "tail <M", "🎉é👩‍👩‍👧\r\n", "퟿\x00z", "wort " * 40_000, "wort " * 40_000]


def plain_cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_by_hand(spark):
    texts = ODD + [f"text <{k} {'ü' * (k % 7)}" for k in range(150)]
    ids = [None, *range(1, len(texts))]
    rows = fill_middle.fill_in_middle(table(spark, texts, ids).repartition(3)).collect()
    source = dict(zip(ids, texts, strict=True))
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        want = plain_cut(r.doc_id, source[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.output_sha256 == hashlib.sha256(want[4].encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((source[r.doc_id] or "").encode()).hexdigest()


def test_fill_in_middle_in_graphemes(spark):
    recipe = fill_middle.Recipe(unit=fill_middle.GRAPHEME, plain_percent=0, spm_percent=50)
    docs = table(spark, ["é" * 9, "👩‍👩‍👧" * 5, None])
    rows = fill_middle.fill_in_middle(docs, recipe=recipe)
    assert {r.doc_id: r.n for r in rows.collect()} == {0: 9, 1: 5, 2: 0}
    for r in rows.collect():
        assert r.prefix_chars is None or (r.prefix_chars % (2 if r.doc_id == 0 else 5) == 0 and r.middle_chars % (2 if r.doc_id == 0 else 5) == 0)
    back = {r.doc_id: r.text for r in fill_middle.rebuilt(rows, recipe).collect()}
    assert back == {0: "é" * 9, 1: "👩‍👩‍👧" * 5, 2: ""}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


# --- centroids


def test_partial_distances_find_the_nearest():
    rnd = np.random.default_rng(2)
    for spread in (3, 400, 1 << 27):
        x, c = rnd.integers(-spread, spread, (500, 64)), rnd.integers(-spread, spread, (8, 64))
        c[5] = c[2]  # a tie for every vector
        label, distance = centroids.nearest(x, c, rnd.permutation(64))
        full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (label == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    c = [x for _, x in start[:k]]
    square = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    told = lambda x: min((square(x, y), n) for n, y in enumerate(c))
    for _ in range(rounds):
        own = [told(x)[1] for _, x in kept]
        c = [[sum(v) // own.count(n) for v in zip(*(x for (_, x), o in zip(kept, own, strict=True) if o == n), strict=True)] if n in own else c[n] for n in range(len(c))]
    last = [told(x) for _, x in kept]
    total = sum(d for d, _ in last)
    return [(i, n, d, sum(e for e, m in last if m == n), total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True)]


def test_clusters_by_brute_force(spark):
    rnd = random.Random(9)
    rows = [(k, [rnd.gauss(k % 3, 0.3) for _ in range(64)]) for k in range(90)]
    rows += [rows[0], rows[1], (1, rows[2][1]), (None, rows[3][1])]  # repeated rows, a repeated id, a null id
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [float("nan")] + [0.0] * 63), (205, [float("-inf")] + [0.0] * 63), (206, [-0.0004] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("i"), "q": F.lit("q"), "cluster": F.lit(5)})
    got = [tuple(r) for r in centroids.clustered(df.repartition(4)).collect()]
    assert sorted(got, key=str) == sorted(plain_clusters(rows), key=str)
    few = df.filter("vec_id = 4 OR vec_id = 5 OR vec_id >= 200")
    assert sorted(map(tuple, centroids.clustered(few).collect())) == sorted(plain_clusters([r for r in rows if r[0] in (4, 5) or (r[0] or 0) >= 200]))
    assert centroids.clustered(df.limit(0)).count() == 0 and centroids.clustered(df.filter("vec_id > 200 AND vec_id < 206")).count() == 0
