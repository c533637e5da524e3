"""The pipeline's rows against a brute-force version of its stages."""

import random
import re

from pyspark.sql import functions as F
from test_llm import SECRETS, brute_components, brute_spans, near_texts, words

import corpus_pipeline
from egress.llm import packing, secret_scan, toxicity


def test_pipeline(spark, tmp_path):
    rnd = random.Random(21)
    common = [f"word{k}" for k in range(150)]
    texts, bad = [], []
    for i in range(300):
        text = rnd.choices(common, k=50)
        bad.append(i % 6 == 0)
        if bad[-1]:
            for _ in range(3):
                text[rnd.randrange(50)] = rnd.choice(["blarg", "zibble"])
        texts.append(" ".join(text))
    extra = [*near_texts(3), texts[1], texts[2].replace(" ", "  "), None, "", *SECRETS, SECRETS[2] + " again", "x" * 30_000]
    texts += extra
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    told = {r.doc_id: r.predicted for r in toxicity.scored(docs.select("doc_id", "text"), labels).collect()}
    assert all(told[i] == b for i, b in enumerate(bad))
    left = [i for i in range(len(texts)) if not told[i]]
    best = {}
    for i in left:
        key = re.sub(r"[\x20\x09-\x0D]", "", texts[i] or "")
        if key not in best or len(texts[i] or "") > len(texts[best[key]] or ""):
            best[key] = i
    left = sorted(best.values())
    _, comp = brute_components([texts[i] for i in left], 5)
    left = [i for k, i in enumerate(left) if comp[k] == k]
    assert sorted(out) == left

    stages, frame = dict(corpus_pipeline.STAGES), docs.filter(F.col("doc_id").isin(left))
    clean = {r.doc_id: r for r in stages["secret_scan"](spark, frame, str(tmp_path)).collect()}
    assert sorted(clean) == left and stages["secret_scan"](spark, frame, str(tmp_path)).columns == docs.columns
    lengths = {}
    for i in left:
        text = texts[i] or ""
        cover = [False] * len(text)
        for a, _, b, _ in brute_spans(text, secret_scan.RULES):
            cover[a:b] = [True] * (b - a)
        want = "".join("[SECRET]" if c and not (k and cover[k - 1]) else "" if c else text[k] for k, c in enumerate(cover))
        assert (clean[i].text or "") == want and (texts[i] is None or clean[i].n_chars == len(want))
        lengths[i] = len(words(want)) + 1
        assert out[i].n_tokens == lengths[i]
    inside = sorted(x for x in lengths.values() if x <= packing.TOKEN_BUDGET)
    distinct = sorted(set(inside))
    cuts = packing.best_boundaries(distinct, [inside.count(x) for x in distinct], packing.N_BUCKETS)
    assert sum(r.padding for r in out.values()) == sum(min(c for c in cuts if c >= x) - x for x in inside)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
