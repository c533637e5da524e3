"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regex yields a Boolean trigram query (an OR of ANDs). The index posts, for every
trigram that some rule asks for, the documents whose lower-cased text holds it; a rule's
postings are intersected and united, and only the remaining documents are verified with the
regex. Rules without a mandatory trigram are verified on all documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egress.llm.store import written

_CLASS_LIMIT, _SET_LIMIT = 8, 64
#: Grams asked for in one AND, a bit each; fewer grams only let more documents through to verification.
MOST_GRAMS = 62


@dataclass(frozen=True)
class Rule:
    """``group`` (0: the match) must have ``least`` characters, else the match is dropped; it still uses up its characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Fixed patterns of the base kinds, in their order. Runs of hex digits are maximal, so asking for 16 at once finds the same ones.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
)
#: Publicly documented credential formats beyond the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*(?:-----END [A-Z ]{0,24}PRIVATE KEY-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

# --- Boolean trigram queries --------------------------------------------------------------

#: An OR of ANDs; one empty AND holds for every document.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _tidy(ands: set[frozenset[str]]) -> Query:
    return frozenset(a for a in ands if not any(b < a for b in ands))


def _both(a: Query, b: Query) -> Query:
    return _tidy({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Query:
    return _tidy({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The exact strings that the nodes match (None: too many), and a query that any match fulfils."""
    strings: set[str] = {""}
    query, whole = ANY, True

    def cut() -> None:
        nonlocal strings, query, whole
        query, strings, whole = _both(query, _of_strings(strings)), {""}, False

    for op, arg in nodes:
        own, more = None, ANY
        if op is sre.LITERAL:
            own = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= _CLASS_LIMIT:
            own = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            own, more = _walk(arg[-1])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                own = set().union(*(s for s, _ in parts))
            more = _tidy(set().union(*(q if s is None else _of_strings(s) for s, q in parts)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            s, q = _walk(inner)
            if s is not None and (least, most) == (0, 1):
                own = s | {""}
            elif s is not None and least == most and len(s) == 1:
                own = {next(iter(s)) * least}
            elif least:
                more = q if s is None else _of_strings(s)
        if own is not None and len(strings) * len(own) <= _SET_LIMIT:
            strings = {a + b for a in strings for b in own}
        else:
            cut()
            query = _both(query, more if own is None else _of_strings(own))
    return (strings, _of_strings(strings)) if whole else (None, _both(query, _of_strings(strings)))


def trigram_query(regex: str) -> Query:
    """A query over lower-cased trigrams that holds in every text with a match."""
    return _walk(sre_parser.parse(regex))[1]


# --- index ---------------------------------------------------------------------------------


def grams_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for ands in trigram_query(r.regex) for g in sorted(ands)[:MOST_GRAMS]})


def build_index(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (gram, id) of the trigrams that the rules ask for, over all whole texts."""
    grams = F.array(*[F.lit(g) for g in grams_of(rules)])
    text = df.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    return text.select("id", F.explode(F.filter(grams, lambda g: F.contains("low", g))).alias("gram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kinds): documents whose postings fulfil a rule's query. A document has one row, and at most one kind for each rule."""
    spark = postings.sparkSession
    branches = [(r.kind, k, sorted(ands)[:MOST_GRAMS]) for r in rules if (q := trigram_query(r.regex)) != ANY for k, ands in enumerate(sorted(q, key=sorted))]
    dim = spark.createDataFrame([(kind, k, g, bit, len(grams)) for kind, k, grams in branches for bit, g in enumerate(grams)], "kind string, branch int, gram string, bit int, need int")
    held = postings.join(F.broadcast(dim), "gram").groupBy("id", "kind", "branch").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, bit)"))).alias("has"), F.max("need").alias("need"))
    return held.filter("has = need").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


# --- verification --------------------------------------------------------------------------

_SPANS = "array<struct<start:bigint,kind_no:int,end:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A lambda that names an expression instead computes it again for each entry."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each entry the fold of all earlier ones.

    Entries are cut into as many pieces as a piece has entries; each is folded with the
    heads of its piece, so n entries take n times the root of n steps, and no state grows.
    """

    def pieces(all_: Column) -> Column:
        n = F.size(all_)
        each = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        last = F.greatest(F.lit(0), (F.ceil(n / each) - 1).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * each + 1, each))

    def told(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, zero, op))
        heads = _let(sums, lambda s: F.transform(s, lambda _, k: F.aggregate(F.slice(s, F.lit(1), k), zero, op)))
        within = lambda p, head: F.transform(p, lambda _, i: F.aggregate(F.slice(p, F.lit(1), i), head, op))
        return _let(heads, lambda h: F.flatten(F.transform(parts, lambda p, k: within(p, F.get(h, k)))))

    return _let(values, lambda all_: _let(pieces(all_), told))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_no, end>> of a rule's matches, leftmost first, in code points.

    The pieces between matches and the matches themselves give the places, since Spark's
    regex functions return no positions.
    """
    pattern = F.lit(rule.regex)
    lens = lambda a: F.transform(a, lambda x: F.char_length(x).cast("long"))
    asked = lens(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    gaps = lens(F.split(text, rule.regex, -1))
    total = lambda a, x: a + x

    def placed(found: Column, gap: Column) -> Column:
        before = _before(F.zip_with(gap, found, total), F.lit(0).cast("long"), total)
        rows = F.filter(F.arrays_zip(before.alias("b"), gap.alias("g"), found.alias("m"), asked.alias("a")), lambda x: x["a"] >= rule.least)
        return F.transform(rows, lambda x: F.struct((x["b"] + x["g"]).alias("start"), F.lit(order).alias("kind_no"), (x["b"] + x["g"] + x["m"]).alias("end")))

    kept = _let(lens(F.regexp_extract_all(text, pattern, F.lit(0))), lambda found: _let(F.slice(gaps, F.lit(1), F.size(found)), lambda gap: placed(found, gap)))
    return F.when(F.rlike(text, pattern), kept).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind_no"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _located(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """All columns of ``df`` as one struct _row, the text as _text, and _at_<kind>: each rule's spans."""
    postings = written(build_index(df, id_col, text_col, rules), "trigram-postings")
    found = candidates(postings, rules).withColumnRenamed("id", "_candidate")
    docs = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    joined = docs.join(found.hint("shuffle_hash"), docs["_id"].eqNullSafe(found["_candidate"]), "left")
    spans = {}
    for k, rule in enumerate(rules):
        own = spans_of(F.col("_text"), rule, k)
        spans[rule.kind] = own if trigram_query(rule.regex) == ANY else F.when(F.array_contains("kinds", rule.kind), own).otherwise(F.array().cast(_SPANS))
    # An exploded array of one entry is computed once; plain columns would be computed again wherever they are used.
    once = joined.select("_row", "_id", "_text", F.explode(F.array(F.struct(*[s.alias(f"_at_{kind}") for kind, s in spans.items()]))).alias("_at"))
    return once.select("_row", "_id", "_text", "_at.*")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, n_<kind> for each base kind, base_sha256, spans.

    ``spans`` is kind:start:end of all rules by start, then rule order; code points, end
    exclusive. Null texts are empty and have no spans; rows that repeat an id, or have a null
    id, are each scanned; an empty table gives an empty result. Other columns are not read.
    A very long text is scanned whole, as one row; time grows with its length and with n
    times the root of n for its n matches.
    """
    located = _located(df.select(id_col, text_col), id_col, text_col, rules)
    base = [r.kind for r in rules if r.base]
    return located.select(
        F.col("_id").alias(id_col),
        *[F.size(f"_at_{kind}").cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(_joined(F.concat(*[F.col(f"_at_{kind}") for kind in base]), rules), 256).alias("base_sha256"),
        _joined(F.concat(*[F.col(f"_at_{r.kind}") for r in rules]), rules).alias("spans"),
    )


def _merged(spans: Column) -> Column:
    """array<struct<start, end>> of sorted spans, overlapping ones as one."""

    def told(all_: Column) -> Column:
        reached = _before(F.transform(all_, lambda x: x["end"]), F.lit(-1).cast("long"), lambda a, x: F.greatest(a, x))
        rows = F.arrays_zip(F.transform(all_, lambda x: x["start"]).alias("start"), reached.alias("reached"))
        heads = F.filter(rows, lambda x: (x["reached"] < 0) | (x["start"] >= x["reached"]))  # where no earlier span goes on
        ends = lambda h: F.concat(F.transform(F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda x: x["reached"]), F.array(F.array_max(F.transform(all_, lambda x: x["end"]))))
        return _let(heads, lambda h: F.zip_with(F.transform(h, lambda x: x["start"]), ends(h), lambda a, b: F.struct(a.alias("start"), b.alias("end"))))

    return F.when(F.size(spans) > 0, _let(spans, told)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


#: Code points of the chunks that a text is cut into, so that a piece is not searched for from the text's beginning.
_CHUNK = 1024


def _piece(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of the text that the chunks make up."""
    first, last = F.floor(a / _CHUNK).cast("int"), F.floor((b - 1) / _CHUNK).cast("int")
    head, tail = (a % _CHUNK + 1).cast("int"), ((b - 1) % _CHUNK + 1).cast("int")
    within = F.substring(F.get(chunks, first), head, (b - a).cast("int"))
    across = F.concat(F.substring(F.get(chunks, first), head, F.lit(_CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(chunks, last), F.lit(1), tail))
    return F.when(b <= a, F.lit("")).when(first == last, within).otherwise(across)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every span of its text replaced by ``mark``, overlapping spans by one mark. Rows, their number and all other columns stay, whatever their names; texts without spans stay as they are, null included.

    A text is one row, whole; time grows with its length and with n times the root of n for
    its n spans.
    """
    spans = F.array_sort(F.concat(*[F.col(f"_at_{r.kind}") for r in rules]))
    located = _located(df, id_col, text_col, rules).select("_row", "_text", _merged(spans).alias("_merged"))
    chunks = F.when(F.size("_merged") > 0, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)))
    cut = located.select("_row", "_text", F.explode(F.array(F.struct("_merged", chunks.alias("chunks")))).alias("_cut"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cut._merged", lambda x: x["end"]))
    starts = F.concat(F.transform("_cut._merged", lambda x: x["start"]), F.array(F.char_length("_text").cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: _piece(F.col("_cut.chunks"), a, b))
    text = F.when(F.size("_cut._merged") > 0, F.array_join(pieces, mark)).otherwise(F.col(f"_row.`{text_col}`"))
    return cut.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL that scans every text with every rule."""
    parts = []
    for k, r in enumerate(rules):
        pattern = r.regex.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.base} AS base, {r.least} AS least, "
            f"regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS a, regexp_split_to_array(t, '{pattern}') AS g FROM d"
        )
    scanned = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}' AND s IS NOT NULL) AS n_{r.kind}" for r in rules if r.base)
    label = "kind || ':' || s || ':' || e"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({scanned}),
        u AS (SELECT doc_id, k, kind, base, least, unnest(m) AS x, unnest(a) AS y, unnest(g[:len(m)]) AS z, unnest(range(len(m))) AS i FROM f),
        p AS (SELECT *, sum(length(z) + length(x)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM u),
        s AS (SELECT doc_id, k, kind, base, (e - length(x))::BIGINT AS s, e::BIGINT AS e FROM p WHERE length(y) >= least)
        SELECT d.doc_id, {counts},
               sha256(coalesce(string_agg({label}, ',' ORDER BY s, k) FILTER (base), '')) AS base_sha256,
               coalesce(string_agg({label}, ',' ORDER BY s, k), '') AS spans
        FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""
