"""MinHash near-dedup with an LSH forest, confirmed on full shingle sets.

A signature of 96 minwise hashes is read in 24 orders, each starting at another block of
four. Sorted in one order, documents that share a block lie together (a region), and those
that share more of the order lie closer (a deeper prefix). In a sparse region all pairs are
candidates. A dense one is read deeper, each part as deep as it takes to leave a few rows,
which are compared whole, and neighbours with the longest common prefix are candidates too.
What deeper prefixes may miss is completed exactly: documents that are still unconnected
are held against all others of the region by size and signature, in blocks and rounds of
bounded size. Two documents with a similarity of 0.8 share no region with a probability of
3e-6.

Equal shingle sets form one class and take part once. Candidates whose signatures agree
too little for the threshold are dropped (a true link fails that test once in 10^7), and
those whose parity sketches prove that the sets differ in too many shingles (no true link
fails that test).
Links are confirmed on the whole texts' sets: first between documents that a sort brings
together, then between components, until no open candidate joins two of them. Texts move
once for that sort, and beyond it only for pairs that are confirmed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from egress.llm.store import released, shuffle_parts, written
from egress.llm.textvec import groups, shingle_hashes, word_hashes
from egress.operators.components import components

HASHES, DEPTH = 96, 4
TREES = HASHES // DEPTH
PERCENT = 80
#: Regions up to this size are compared whole.
SPARSE = 8
#: Rows of one side of a block, and pairs of a block looked at together.
BLOCK, CHUNK = 1024, 20_000
#: First links: earlier documents looked at, and sets compared at most.
WINDOW, TRIES = 128, 3
#: Open candidates for each document that are confirmed in one round; in dense regions the number grows by a factor from round to round, so three rounds exhaust a block.
OPEN, GROWTH = 4, 16

#: A parity sketch has two bits for each shingle, up to 2 to the power of this.
MOST_BITS = 15

_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def least_agreement(percent: int) -> int:
    """Agreeing hashes below which a similarity of ``percent`` is out of the question: 5.3 standard deviations."""
    p = percent / 100
    return max(1, int(HASHES * p - 5.3 * (HASHES * p * (1 - p)) ** 0.5))


def signature(shingles: np.ndarray) -> np.ndarray:
    """96 16-bit minwise hashes of distinct 64-bit shingle hashes."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (_A[:, None] * x[None, at : at + 1024] + _B[:, None]).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each residue class of the hashes: whether an odd number of shingles fall in it. Two sets differ in at least as many shingles as their sketches differ in bits; a longer sketch folds onto a shorter one."""
    bits = 1 << min(MOST_BITS, max(8, (2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(odd_a: list[bytes], odd_b: list[bytes], n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the parity sketches of pairs allow the similarity: a union u and an intersection i with 100 i >= percent u differ in (a + b) (100 - percent) / (100 + percent) shingles at most."""
    out = np.zeros(len(odd_a), bool)
    kinds: dict = {}
    for k, (x, y) in enumerate(zip(odd_a, odd_b, strict=True)):
        kinds.setdefault((len(x), len(y)), []).append(k)
    for (x, y), at in kinds.items():
        least = min(x, y) // 8
        a, b = (np.bitwise_xor.reduce(np.frombuffer(b"".join([side[k] for k in at]), np.uint64).reshape(len(at), -1, least), axis=1) for side in (odd_a, odd_b))
        out[at] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (n_a[at] + n_b[at])
    return out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for piece in groups(texts):
        hashes, counts = shingle_hashes(*word_hashes(texts[piece]), width)
        ends = np.cumsum(counts)
        out += [np.unique(hashes[e - n : e]) for e, n in zip(ends, counts, strict=True)]
    return out


def sketched(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, text_hash, n, node (128-bit digest of the set; null if empty), sig (big-endian, so that bytes sort as numbers), odd (parity sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sig = [signature(s).astype(">u2").tobytes() if len(s) else None for s in sets]
            odd = [parity(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(map(len, sets), pa.int64()), *(pa.array(c, pa.binary()) for c in (node, sig, odd))], names=["id", "text_hash", "n", "node", "sig", "odd"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, n long, node binary, sig binary, odd binary")


PAIRS = "a binary, b binary, agree int"


def _near_pairs(rows: DataFrame, percent: int, deep: bool) -> DataFrame:
    """Candidates among rows sorted by (region, order), whose sizes and signatures allow a link: all pairs of a region of at most SPARSE rows; if ``deep``, neighbours and the pairs of each prefix that no more than SPARSE rows share."""
    need, around = least_agreement(percent), max(SPARSE - 1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        told = 0  # rows of ``held`` whose pairs with later ones are told
        for batch in batches:
            if not batch.num_rows:
                continue
            own = (
                np.array(batch.column("region").to_pylist(), object),
                np.array(batch.column("node").to_pylist(), object),
                batch.column("n").to_numpy(),
                np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u2").reshape(-1, HASHES).astype(np.uint16),
                np.array(batch.column("odd").to_pylist(), object),
            )
            held = own if held is None else tuple(np.concatenate([h, o]) for h, o in zip(held, own, strict=True))
            ready = len(held[0]) - 2 * around  # later rows still lack what follows them
            if ready > told:
                yield from pairs(held, told, ready)
                cut = max(0, ready - 2 * around)
                held, told = tuple(h[cut:] for h in held), ready - cut
        if held is not None:
            yield from pairs(held, told, len(held[0]))

    def pairs(held: tuple, first: int, end: int) -> Iterator[pa.RecordBatch]:
        region, node, n, sig, odd = held
        a, b = [], []
        shared = common(region, sig) if deep and len(region) > 1 else None
        for d in range(1, around + 1):
            i = np.arange(first, min(end, len(region) - d))
            i = i[region[i] == region[i + d]]
            if deep and d > 2 and len(i):
                i = i[alone(shared, i, d)]
            a.append(i)
            b.append(i + d)
        i, j = np.concatenate(a), np.concatenate(b)
        fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        for at in range(0, len(i), CHUNK):
            p, q = i[at : at + CHUNK], j[at : at + CHUNK]
            agree = (sig[p] == sig[q]).sum(axis=1)
            p, q, agree = (x[agree >= need] for x in (p, q, agree))
            keep = may_link(odd[p].tolist(), odd[q].tolist(), n[p], n[q], percent)
            if keep.any():
                yield _pairs(node[p[keep]], node[q[keep]], agree[keep])

    def common(region: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Length of the prefix that each row shares with the next one in its tree's order, 0 in another region."""
        tree = np.fromiter((r[0] for r in region), np.int64, len(region))
        at = (tree[:, None] * DEPTH + np.arange(HASHES)) % HASHES
        ordered = np.take_along_axis(sig, at, axis=1)
        differ = ordered[:-1] != ordered[1:]
        long = np.where(differ.any(axis=1), differ.argmax(axis=1), HASHES)
        return np.where(region[:-1] == region[1:], long, 0)

    def alone(shared: np.ndarray, i: np.ndarray, d: int) -> np.ndarray:
        """Whether at most SPARSE rows share the prefix that rows i and i + d have in common."""
        depth = np.min([shared[i + k] for k in range(d)], axis=0)
        rows = np.full(len(i), d + 1)
        for step, start in ((-1, i - 1), (1, i + d)):
            on = np.ones(len(i), bool)
            for k in range(around):
                at = start + step * k
                inside = (at >= 0) & (at < len(shared))
                on &= inside & (shared[np.clip(at, 0, len(shared) - 1)] >= depth)
                rows += on
        return rows <= SPARSE

    return rows.mapInArrow(run, PAIRS)


def _pairs(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    swap = [x > y for x, y in zip(a, b, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a).tolist(), pa.binary()), pa.array(np.where(swap, a, b).tolist(), pa.binary()), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, ca, cb, linked) of pairs (a, b) in components ca and cb, on the full sets of their classes' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            linked = []
            for piece in groups([x + y for x, y in zip(left, right, strict=True)]):
                for s, t in zip(shingle_sets(left[piece], width), shingle_sets(right[piece], width), strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    linked.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ends), pa.array(linked, pa.bool_())], names=[*ends, "linked"])

    ends = ("a", "b", "ca", "cb")
    with_a = pairs.select(*ends).join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select(*ends, "text_a", "text_b").mapInArrow(run, "a binary, b binary, ca binary, cb binary, linked boolean")


def _first_links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between documents that a sort by candidates brings together.

    A document's label is the least node within two candidate steps. In (label, signature)
    order each document is held against the ones before it with the same label, likeliest
    first, until it is linked; one pass moves each text once and links most of a group.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    one = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    label = both.join(one, "b").groupBy("a").agg(F.min("m").alias("label")).select(F.col("a").alias("node"), "label")
    need = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, held = None, []
        for batch in batches:
            out = []
            own = batch.column("text").to_pylist()
            for piece in groups(own):
                sets = shingle_sets(own[piece], width)
                rows = batch.slice(piece.start, len(sets))
                sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), ">u2").reshape(-1, HASHES).astype(np.uint16)
                for k, (mark, node) in enumerate(zip(rows.column("label").to_pylist(), rows.column("node").to_pylist(), strict=True)):
                    if mark != label:
                        label, held = mark, []
                    if held:
                        agree = (np.stack([h[1] for h in held]) == sig[k]).sum(axis=1)
                        for i in np.argsort(-agree, kind="stable")[:TRIES]:
                            if agree[i] < need:
                                break
                            s, t = held[i][2], sets[k]
                            both = len(np.intersect1d(s, t, assume_unique=True))
                            if 100 * both >= percent * (len(s) + len(t) - both):
                                out.append((held[i][0], node))
                                break
                    held = [*held[-WINDOW + 1 :], (node, sig[k], sets[k])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.binary()), pa.array([max(x) for x in out], pa.binary())], names=["a", "b"])

    keys = ["label", "sig", "node"]
    rows = texts.join(label, "node").select("label", "sig", "node", "text")
    return written(rows.repartitionByRange(shuffle_parts(pairs.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary"), "near-first")


def _with_comps(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs between different components, with these as ca and cb."""
    ends = [comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").filter("ca != cb")


def _merged(comps: DataFrame, told: DataFrame) -> DataFrame:
    """Components of all nodes after the links among ``told``: only the components that these join are gone through."""
    linked = components(told.filter("linked").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    new = linked.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    return written(comps.join(new, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")), "near-comps")


def _joined(pairs: DataFrame, texts: DataFrame, comps: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirms candidates until none that is open joins two components: (node, comp) of all nodes.

    When no more than OPEN candidates are open for each document, all are confirmed at once;
    else every component asks for its likeliest open candidate, round by round.
    """
    most = OPEN * texts.count()
    while True:
        seen = Observation()
        open_ = written(_with_comps(pairs, comps).observe(seen, F.count("*").alias("n")), "near-open")
        if not seen.get["n"]:
            return comps
        some = seen.get["n"] > most
        asked = open_
        if some:
            sides = open_.select(F.col("ca").alias("c"), "a", "b", "ca", "cb", "agree").union(open_.select("cb", "a", "b", "ca", "cb", "agree"))
            asked = written(sides.groupBy("c").agg(F.max(F.struct("agree", "a", "b", "ca", "cb")).alias("x")).select("x.a", "x.b", "x.ca", "x.cb").distinct(), "near-asked")
        told = written(_confirmed(asked, texts, width, percent), "near-told")
        last, comps = comps, _merged(comps, told)
        released(last)
        if not some:
            released(open_, told)
            return comps
        rest = written(open_.join(told.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "agree"), "near-pairs")
        released(pairs, open_, asked, told)
        pairs = rest


def _completed(crowded: DataFrame, classes: DataFrame, texts: DataFrame, comps: DataFrame, width: int, percent: int) -> DataFrame:
    """Components after the links within dense regions that deeper prefixes missed.

    Each document outside its region's largest component is held against all others of the
    region, by size, signature and parity sketch. A cell is one block of such documents against one block
    of the region; in each round a document asks there for its next likeliest open
    candidates, OPEN of them at first and GROWTH times as many from round to round, until no
    document has more. So a round's rows are bounded by the documents' number, whatever the
    size of a region, and no candidate is given up.
    """
    members = written(crowded.join(classes.select("node", "n", "sig", "odd"), "node"), "near-members")
    most, asking = OPEN, None
    while True:
        placed = members.join(comps, "node")
        by_comp = placed.groupBy("region", "comp").agg(F.count("*").alias("k"))
        regions = by_comp.groupBy("region").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("total"), F.count("*").alias("comps")).filter("comps > 1")
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        regions = written(regions.select("region", F.col("top.comp").alias("top"), blocks(F.col("total")).alias("across"), blocks(F.col("total") - F.col("top.k")).alias("down")), "near-regions")
        rows = placed.join(regions, "region").withColumn("h", F.xxhash64("node"))
        strays = rows.filter("comp != top").withColumns({"i": F.pmod("h", "down").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("across") - 1)), "side": F.lit(0)})
        if asking is None:
            strays = strays.withColumns({"after": F.lit(None).cast("int"), "beyond": F.lit(None).cast("binary")})
        else:  # only those with candidates left, from where they stopped
            strays = strays.join(asking.select("region", "j", F.col("stray").alias("node"), F.col("agree").alias("after"), F.col("other").alias("beyond")), ["region", "j", "node"])
        others = rows.withColumns({"j": F.pmod("h", "across").cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("down") - 1)), "side": F.lit(1), "after": F.lit(None).cast("int"), "beyond": F.lit(None).cast("binary")})
        columns = ["region", "i", "j", "side", "node", "comp", "n", "sig", "odd", "after", "beyond"]
        cells = strays.select(columns).unionByName(others.select(columns)).repartition(shuffle_parts(members.sparkSession), "region", "i", "j").sortWithinPartitions("region", "i", "j", "side")
        seen = Observation()
        found = written(cells.mapInArrow(_asks(most, percent), ASKS).observe(seen, F.count("*").alias("n"), F.count_if("more").alias("more")), "near-late")
        released(regions, *([] if asking is None else [asking]))
        asking = found.filter("more")
        asking._written_at = found._written_at
        if seen.get["n"]:
            named = found.select(F.least("stray", "other").alias("a"), F.greatest("stray", "other").alias("b")).distinct()
            told = written(_confirmed(_with_comps(named, comps), texts, width, percent), "near-told")
            last, comps = comps, _merged(comps, told)
            released(last, told)
        if not seen.get["more"]:
            released(members, found)
            return comps
        most *= GROWTH


ASKS = "region binary, j int, stray binary, other binary, agree int, more boolean"


def _asks(most: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each stray (side 0) of a cell its ``most`` likeliest candidates of other components (side 1) after the last ones told (after, beyond), likeliest first; the last of them says whether there are more. A pair counts in the first tree in which it shares a region."""
    need = least_agreement(percent)

    def told(cell: tuple, strays: list, others: list) -> Iterator[pa.RecordBatch]:
        region, _, j = cell
        if not strays or not others:
            return
        sig = np.frombuffer(b"".join(s[3] for s in strays), ">u2").reshape(-1, HASHES).astype(np.uint16)
        sizes, comp = np.array([s[2] for s in strays]), np.array([s[1] for s in strays], object)
        at, to, how = [], [], []
        for k, (_, own, n, mine, *_) in enumerate(others):
            fits = np.flatnonzero((100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (comp != own))
            same = sig[fits] == np.frombuffer(mine, ">u2").astype(np.uint16)
            agree = same.sum(axis=1)
            hit = np.flatnonzero(agree >= need)
            hit = hit[same[hit].reshape(-1, TREES, DEPTH).all(axis=2).argmax(axis=1) == region[0]]
            at.append(fits[hit])
            to.append(np.full(len(hit), k))
            how.append(agree[hit])
        at, to, how = np.concatenate(at), np.concatenate(to), np.concatenate(how)
        theirs = np.array([o[2] for o in others])
        keep = [may_link([strays[x][4] for x in at[k : k + CHUNK]], [others[y][4] for y in to[k : k + CHUNK]], sizes[at[k : k + CHUNK]], theirs[to[k : k + CHUNK]], percent) for k in range(0, len(at), CHUNK)]
        at, to, how = (x[np.concatenate(keep)] if keep else x for x in (at, to, how))
        names = np.array([o[0] for o in others], object)
        rank = np.argsort(np.argsort(names))  # order of the others' digests
        order = np.lexsort((rank[to], -how, at))
        at, to, how = at[order], to[order], how[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        out = []
        for start, end in zip(starts, np.r_[starts[1:], len(at)] if len(at) else [], strict=True):
            node, *_, after, beyond = strays[at[start]]
            if after is not None:
                start += sum(1 for k in range(start, end) if (-how[k], names[to[k]]) <= (-after, beyond))
            out += [(region, j, node, names[to[k]], int(how[k]), k == start + most - 1 and k + 1 < end) for k in range(start, min(start + most, end))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.bool_()), strict=True)], names=["region", "j", "stray", "other", "agree", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = None, ([], [])
        for batch in batches:
            for region, i, j, side, *rest in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if (region, i, j) != cell:
                    if cell is not None:
                        yield from told(cell, *sides)
                    cell, sides = (region, i, j), ([], [])
                if side == 0 or sides[0]:
                    sides[side].append(rest)
        if cell is not None:
            yield from told(cell, *sides)

    return run


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    A text with fewer words than ``width`` has all its words as one shingle. Null and empty
    texts have none, and stand alone. Rows that repeat an id and its text are all told the
    same; null ids are told their component's smallest id, or null. An empty table gives an
    empty result. A text of any length is sketched and compared whole. Other columns are not read.
    """
    parts = shuffle_parts(df.sparkSession)
    docs = written(sketched(df, id_col, text_col, width), "near-sketches")
    classes = written(
        docs.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("rep"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd")),
        "near-classes",
    )
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    region = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)))
    leaves = classes.select("node", "sig", tree.alias("tree")).select("node", region.alias("region"))
    regions = leaves.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(leaves.join(regions, "region"), "near-shared")
    order = F.concat(F.expr(f"substring(sig, conv(hex(substring(region, 1, 1)), 16, 10) * {2 * DEPTH} + 1)"), "sig")
    placed = shared.join(classes.select("node", "n", "sig", "odd"), "node").withColumn("order", order)
    columns = ["region", "node", "n", "sig", "odd"]
    sparse = placed.filter(F.col("size") <= SPARSE).repartition(parts, "region").sortWithinPartitions("region")
    dense = placed.filter(F.col("size") > SPARSE).repartitionByRange(parts, "region", "order", "node").sortWithinPartitions("region", "order", "node")
    pairs = _near_pairs(sparse.select(*columns), percent, False).union(_near_pairs(dense.select(*columns), percent, True))
    pairs = written(pairs.groupBy("a", "b").agg(F.max("agree").alias("agree")), "near-pairs")

    crowded = shared.filter(F.col("size") > SPARSE).select("region", "node")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct()
    reps = classes.join(asked, "node").select("node", "sig", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    source = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    match = source["id"].eqNullSafe(reps["rep_id"]) & (source["text_hash"] == reps["rep_hash"])
    texts = written(source.join(reps, match).groupBy("node").agg(F.first("text").alias("text"), F.first("sig").alias("sig")), "near-texts")

    first = _first_links(pairs, texts, width, percent)
    comps = written(texts.select("node").join(components(first), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "near-comps")
    released(first)
    comps = _joined(pairs, texts, comps, width, percent)
    comps = _completed(crowded, classes, texts, comps, width, percent)
    released(texts, shared)

    owned = classes.select("node", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    told = owned.select("node", "comp").join(owned.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id")
    out = docs.select("id", "n", "node").join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, all columns, of the smallest id of each component. Rows that share an id stay or go together."""
    kept = near_components(df, id_col, text_col, width, percent).filter("kept").select(F.col(id_col).alias("_kept")).distinct()
    return df.join(kept.hint("shuffle_hash"), df[id_col].eqNullSafe(kept["_kept"]), "left_semi")


def oracle_sql(width: int, percent: int = PERCENT) -> str:
    """DuckDB SQL: all pairs that share a shingle, then reachability."""
    return rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id != b.doc_id GROUP BY ALL),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""
