"""The corpus pipeline, stage by stage, against the operators and brute force, and the stages' defined cases."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewren.llm import queries
from sedgewren.llm.common import staged
from tests.llm.test_llm import DOCS, LONG, brute_components, share_out

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
CLASHING = ("row", "copy", "times", "version", "size", "score", "predicted", "quality_score", "_words", "_copy", "_id", "kept", "hash", "bucket_", "token_ids")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(staged(stage(spark, kept[-1], DATA), f"test-{name}"))
    assert all(d.columns == columns for d in kept[:-1])
    texts = [d.toPandas() for d in kept[:-1]]
    toxic = set(queries.op8_toxicity(spark, DATA).where("predicted = 1").toPandas().doc_id)
    assert set(texts[1].doc_id) == set(texts[0].doc_id) - toxic

    before = texts[2]
    want = {i for i, (_, c) in brute_components(zip(before.doc_id, before.text), 80).items() if i == c}
    assert set(texts[3].doc_id) == want and texts[3].doc_id.is_unique
    sizes = texts[3].assign(n=[len(t.encode().split()) for t in texts[3].text]).groupby("source").n.sum()
    names = sorted(sizes.index, key=str.encode)
    target = share_out([int(sizes[n]) for n in names], [[5, 2, 1][i % 3] for i in range(len(names))], int(sizes.sum()), 3)
    taken = texts[4].assign(n=[len(t.encode().split()) for t in texts[4].text]).groupby("source").n.sum()
    assert np.abs(np.array([taken.get(n, 0) for n in names]) - target).max() <= 0.05 * max(target) + 30
    assert texts[4].groupby("doc_id").size().max() <= 3
    assert kept[-1].count() == len(texts[4])


@pytest.fixture(scope="module")
def awkward(spark):
    a, b = "one two three four five six seven eight nine ten", "another text of ten words that is like nothing else"
    rows = [(1, a, "en", "a", 48), (7, a.upper(), "en", "a", 48), (7, b, "en", "a", 48), (9, b, "en", "a", 48), (3, None, None, None, None), (3, None, None, None, None), (4, "", "de", "b", 0)]
    rows += [(5, " \n\t", "de", "b", 3), (6, LONG, "fr", "c", len(LONG)), (6, LONG, "fr", "c", len(LONG)), (None, a, "en", "b", 48), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("mine"))
    return docs


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_cases(spark, awkward, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, awkward, DATA)
    rows = got.collect()
    assert stage(spark, awkward.limit(0), DATA).count() == 0
    if name == "tokens":
        assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in rows) == sorted((r["doc_id"] or 0, bool(r["text"])) for r in awkward.collect())
        return
    assert got.columns == awkward.columns and all(r[c] == "mine" for r in rows for c in CLASHING)
    before = Counter(awkward.collect())
    after = Counter(rows)
    assert not set(after) - set(before)
    if name in ("toxicity", "quality"):
        assert all(after[r] in (0, n) for r, n in before.items())  # repeated rows go or stay together
    if name == "toxicity":
        assert after == before
    if name == "near_duplicates":
        ids = Counter((r["doc_id"], (r["text"] or "")[:4]) for r in rows)
        assert ids == Counter({(1, "one "): 1, (7, "anot"): 1, (3, ""): 1, (4, ""): 1, (5, " \n\t"): 1, (6, "w0 w"): 1, (None, "one "): 1, (None, ""): 1})
    if name == "mixing":
        assert all(n <= 3 * before[r] for r, n in after.items()) and all((r["text"] or "").split() for r in rows)
