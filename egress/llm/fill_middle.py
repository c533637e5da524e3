"""Fill-in-the-middle examples: a text cut in three at two units, its parts in another order between markers.

A pandas UDF takes the texts in Arrow batches. ``finditer`` of the regex library passes over
a text's units once and their ends are kept as 32-bit offsets, so both cuts are two lookups
and two slices whatever the unit is (code points, graphemes, words). Cuts and forms come from
a digest of the id alone: a rerun, another partitioning or a lost executor changes nothing.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from egress.llm.textvec import groups

#: One unit is one code point, or one grapheme.
CODE_POINT, GRAPHEME = r"(?s:.)", r"\X"
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Recipe:
    """``seed`` opens what is hashed for an id; percentages of texts that stay plain, and of the others that open with the suffix. No marker may be part of another's beginning or hold another."""

    seed: str = "1"
    unit: str = CODE_POINT
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_percent: int = 10
    spm_percent: int = 20

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(recipe: Recipe, key: str) -> list[int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{recipe.seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def unit_ends(text: str, unit) -> array:
    """Offsets at which the units of a text end, four bytes each."""
    return array("I", (m.end() for m in unit.finditer(text)))


def cut(recipe: Recipe, unit, key: str, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    one, two, three, four = draws(recipe, key)
    if not text or any(m in text for m in recipe.markers) or three % 100 >= 100 - recipe.plain_percent:
        return n, "plain", None, None, text
    first, second = sorted((one % (n + 1), two % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < recipe.spm_percent:
        return n, "spm", a, b - a, f"{recipe.suffix}{suffix}{recipe.prefix}{prefix}{recipe.middle}{middle}"
    return n, "psm", a, b - a, f"{recipe.prefix}{prefix}{recipe.suffix}{suffix}{recipe.middle}{middle}"


def restored(recipe: Recipe, output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    opening, between = (recipe.prefix, recipe.suffix) if form == "psm" else (recipe.suffix, recipe.prefix)
    one, rest = output[len(opening) :].split(between, 1)
    two, middle = rest.split(recipe.middle, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", recipe: Recipe = Recipe()) -> DataFrame:
    """One row per input row: id, units, form (plain, psm, spm), code points of prefix and middle (null if plain), output, its digest, and that of the text rebuilt from output and form.

    Null and empty texts, and texts that hold a marker, stay plain. A null id is hashed as
    empty text. Rows that repeat an id are cut alike for equal texts. A very long text is cut
    whole, with four bytes of offsets for each unit. An empty table gives an empty result.
    Other columns are not read.
    """

    @pandas_udf(FIELDS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        unit = regex.compile(recipe.unit)
        for keys, texts in batches:
            keys, texts = keys.tolist(), texts.tolist()
            for piece in groups(texts):
                rows = []
                for key, text in zip(keys[piece], texts[piece], strict=True):
                    n, form, a, b, output = cut(recipe, unit, key, text)
                    rows.append((n, form, a, b, output, _sha(output), _sha(restored(recipe, output, form))))
                out = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
                yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    made = df.select(F.col(id_col), run(key, F.coalesce(F.col(text_col), F.lit(""))).alias("made"))
    return made.select(id_col, "made.*")


def rebuilt(df: DataFrame, recipe: Recipe = Recipe(), output_col: str = "output", form_col: str = "form", name: str = "text") -> DataFrame:
    """``df`` with ``name``: the text that each output was made of. Nulls stay null."""

    @pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(recipe, o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return df.withColumn(name, run(F.col(output_col), F.col(form_col)))


#: The default recipe on documents in DuckDB SQL, whose string functions count code points.
ORACLE_SQL = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    x AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS p, ('0x' || h[9:16])::BIGINT % (n + 1) AS q, ('0x' || h[17:24])::BIGINT % 100 AS r, ('0x' || h[25:32])::BIGINT % 100 AS s FROM d),
    c AS (SELECT *, least(p, q) AS a, greatest(p, q) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM x)
    SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
                  ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
    FROM c"""
