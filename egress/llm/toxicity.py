"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick.

Texts are folded first: case, accents, look-alike letters of other scripts, digits and
signs that stand for letters. Terms are whole words or word beginnings of the folded text.
Their weights are log odds between labelled toxic and clean documents; a hit inside an
exception phrase does not count; the sum is divided by the length, and a logistic curve
fitted on the same labelled rows turns it into a score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from egress.llm.store import fold_of

#: Bound on the labelled rows that the lexicon is fitted on: those with the smallest hashes.
MOST_LABELLED = 60_000
#: A term is in so many toxic training texts at least, whatever their number; and this share of its occurrences is in toxic texts.
SUPPORT, PRECISION = 3, 0.7
#: Most probability that a term without a leaning is in so many toxic texts by chance, or more.
CHANCE = 1e-4
LEAST_WORDS = 20
THRESHOLD = 0.7

#: Fixed look-alikes of Latin letters, and signs used for letters.
CYRILLIC = dict(zip("авсԁенһіїјкӏмпорԛѕтуѵхѡ", "abcdehhiijkimnopqstyvxw", strict=True))
GREEK = dict(zip("αβγεζηικνορτυχω", "abyezniknoptuxw", strict=True))
SIGNS = dict(zip("013457@$!|", "oieastasii", strict=True))
#: i, l, 1, ! and | can't be told apart, so they fold to one letter.
SAME = {"l": "i"}


class _Folds(dict):
    """Code point -> folded text, worked out when first met: Unicode decomposition, then look-alikes; marks and invisible signs vanish, other signs part words."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()).lower():
            kind = unicodedata.category(c)
            c = CYRILLIC.get(c) or GREEK.get(c) or SIGNS.get(c) or c
            if c.isalnum():
                out += SAME.get(c, c)
            elif kind not in ("Mn", "Cf"):
                out += " "
        self[code] = out
        return out


_FOLDS = _Folds()


def folded(text: str | None) -> str:
    """Folded words, one blank before and after each."""
    return " " + " ".join((text or "").translate(_FOLDS).split()) + " "


@dataclass(frozen=True)
class Lexicon:
    """Terms start with a blank and, if whole words, end with one. ``exceptions``: folded phrases in which terms don't count."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    intercept: float = -4.0
    slope: float = 1.0
    least_words: int = LEAST_WORDS

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a


@dataclass
class Matcher:
    lexicon: Lexicon
    found: object = field(init=False)

    def __post_init__(self):
        self.found = self.lexicon.automaton()

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms in a folded text, outside exception phrases."""
        if not len(self.found):
            return []
        all_hits = [(end + 1 - n, end + 1, w) for end, (n, w) in self.found.iter(text)]
        if not any(w is None for _, _, w in all_hits):
            return all_hits
        out, reach = [], 0  # by their starts, exceptions first: the farthest end of those begun so far tells
        for start, end, weight in sorted(all_hits, key=lambda h: (h[0], h[2] is not None)):
            if weight is None:
                reach = max(reach, end)
            elif end > reach:
                out.append((start, end, weight))
        return out

    def load(self, text: str) -> float:
        """Log of the summed weights for 1,000 words."""
        return math.log1p(1000 * sum(w for _, _, w in self.hits(text)) / max(text.count(" ") - 1, self.lexicon.least_words))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.lexicon.intercept + self.lexicon.slope * self.load(text)))))


def _features(text: str) -> Counter:
    """Occurrences of whole words, and of their beginnings of 4 to 8 letters."""
    out: Counter = Counter()
    for w, n in Counter(text.split()).items():
        out[f" {w} "] += n
        for k in range(4, min(8, len(w)) + 1):
            out[" " + w[:k]] += n
    return out


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(text, toxic) of the labelled rows in the training folds, ``most`` at most. Copies count as often as they are labelled; labels of null ids or without a toxic mark are left out; an id labelled twice is toxic if one label says so.

    The chosen ids are bounded, so they are broadcast and texts don't move.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.filter(fold_of("doc_id", 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def damped(n: int) -> int:
    """What n occurrences in one labelled text count while weights are learned, in hundredths: log2(1 + n), so that more always count more, but one text alone makes no weight. Whole numbers, so that sums don't depend on their order. Scores count all occurrences alike."""
    return round(100 * math.log2(1 + n))


def _counted(rows: DataFrame, asked: frozenset[str] | None) -> DataFrame:
    """feature, texts, clean_texts, toxic, clean: toxic and clean texts with the feature, and its damped occurrences in them. ``asked`` None: all features of toxic texts, in those texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, clean_texts, toxic, clean = Counter(), Counter(), Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if asked is None and not label:
                    continue
                own = {f: damped(n) for f, n in _features(folded(text)).items() if asked is None or f in asked}
                (toxic if label else clean).update(own)
                (texts if label else clean_texts).update(own.keys())
        names = list(toxic | clean)
        for at in range(0, len(names), 50_000):
            own = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array([c[n] for n in own], pa.int64()) for c in (texts, clean_texts, toxic, clean))], names=["feature", "texts", "clean_texts", "toxic", "clean"])

    sums = [F.sum(c).alias(c) for c in ("texts", "clean_texts", "toxic", "clean")]
    return rows.mapInArrow(run, "feature string, texts long, clean_texts long, toxic long, clean long").groupBy("feature").agg(*sums)


def by_chance(texts: int, clean_texts: int, share: float) -> float:
    """Probability that of all texts with a term so many or more are toxic, if each is toxic with probability ``share``."""
    n = texts + clean_texts
    if not 0 < share < 1 or texts <= n * share:
        return 1.0
    odds = share / (1 - share)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(texts + 1) - math.lgamma(clean_texts + 1) + texts * math.log(share) + clean_texts * math.log1p(-share))
    total = 0.0
    for k in range(texts, n + 1):
        total += term
        term *= (n - k) / (k + 1) * odds
    return min(total, 1.0)


def chosen_terms(counts: dict[str, tuple[float, float]], n_toxic: int, n_clean: int, precision: float = PRECISION) -> dict[str, float]:
    """Terms (with their toxic and clean occurrences) that are pure enough, shortest beginnings first; a term that a chosen one begins adds nothing."""
    terms: dict[str, float] = {}
    for term in sorted(counts, key=lambda t: (len(t), t)):
        toxic, clean = counts[term]
        if toxic < precision * (toxic + clean) or any(term[:n] in terms for n in range(4, len(term))):
            continue
        terms[term] = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return {t: w for t, w in terms.items() if w > 0}


def _exceptions(rows: DataFrame, lexicon: Lexicon, support: int) -> tuple[str, ...]:
    """Phrases of a term's word and a neighbour that ``support`` clean training texts have and no toxic one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, toxic, clean = Matcher(lexicon), Counter(), Counter()
        for batch in batches:
            for raw, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text, own = folded(raw), set()
                for start, _, _ in matcher.hits(text):
                    end = text.index(" ", start + 1)
                    after, before = text.find(" ", end + 1), text.rfind(" ", 0, start) if start else -1
                    own |= {text[start : after + 1]} if after > 0 else set()
                    own |= {text[before : end + 1]} if before >= 0 else set()
                (toxic if label else clean).update(own)
        names = list(toxic | clean)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())], names=["phrase", "toxic", "clean"])

    found = rows.mapInArrow(run, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return tuple(sorted(r["phrase"] for r in found.filter((F.col("toxic") == 0) & (F.col("clean") >= support)).collect()))


def _curve(loads: np.ndarray, labels: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic regression by Newton steps."""
    if not len(loads) or labels.min() == labels.max():
        return -4.0, 1.0
    x, beta = np.c_[np.ones(len(loads)), loads], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (p - labels) / len(x) + ridge * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 1e-6))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, support: int = SUPPORT, precision: float = PRECISION) -> Lexicon:
    """Lexicon, exceptions and curve from labelled training rows.

    Without toxic training rows the lexicon is empty and all scores are low. What comes to the driver is
    bounded by ``most``: features of the chosen rows in too many toxic texts for chance, and a load and label for each row.
    """
    rows = training_rows(docs, labels, most)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    share = n_toxic / max(n_toxic + n_clean, 1)
    least = next((k for k in range(support, n_toxic + 1) if by_chance(k, 0, share) <= CHANCE), support)
    frequent = frozenset(r["feature"] for r in _counted(rows, None).filter(F.col("texts") >= least).select("feature").collect())
    leaning = _counted(rows, frequent).filter(F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))).collect() if frequent else []
    counts = {r["feature"]: (r["toxic"] / 100, r["clean"] / 100) for r in leaning if n_clean == 0 or by_chance(r["texts"], r["clean_texts"], share) <= CHANCE}
    lexicon = Lexicon(chosen_terms(counts, n_toxic, n_clean, precision))
    lexicon = Lexicon(lexicon.terms, _exceptions(rows, lexicon, 3) if lexicon.terms else ())

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matcher.load(folded(t)) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic").cast(pa.int32())], names=["load", "toxic"])

    pairs = rows.mapInArrow(loads, "load double, toxic int").toPandas()
    intercept, slope = _curve(pairs["load"].to_numpy(float), pairs["toxic"].to_numpy(float))
    return Lexicon(lexicon.terms, lexicon.exceptions, intercept, slope)


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, columns in ``keep``, score. A very long text is scored whole. Null and empty texts get the score of no hit; repeated rows are each scored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            scores = [matcher.score(folded(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    rows = df.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("_" * (1 + max(map(len, (id_col, *keep))))))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double"])
    return rows.mapInArrow(run, schema)


def reject(df: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores below ``threshold``; null and empty texts have no hit and stay. Repeated rows stay or go together; an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([matcher.score(folded(t)) < threshold for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def scored(docs: DataFrame, labels: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, with a lexicon learned outside the held-out fold. Null ids count as empty text in the fold; texts as in :func:`score`."""
    out = score(docs, lexicon or learn(docs, labels))
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
