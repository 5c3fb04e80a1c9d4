"""Model boundaries with stubs, refusals, filters, incremental index, registries, and exact rounding."""

import random

import pytest
from pyspark.sql import functions as F

from sedgewren.functions import text as T
from sedgewren.operators import answering, catalog, dense, lexical, models
from sedgewren.plans.retrieve import _fixture, asking
from sedgewren.streaming.ingest import ingest, page_stream

CHUNKS = "chunk_id string, document_id long, chunk_index int, folder string, filename string, page_num int, text string"


def letters():
    """An encoder that counts three letters."""
    return lambda texts: [[t.count("a"), t.count("b"), t.count("c")] for t in texts]


def chunks(spark, texts):
    return spark.createDataFrame([(f"k{i}", i // 2, i % 2, "xy"[i % 2], f"f{i // 2}", 1, t) for i, t in enumerate(texts)], CHUNKS)


def test_embeddings_are_unit_vectors(spark):
    rows = spark.createDataFrame([(1, "aab"), (2, None), (3, "ccc")], "id long, text string")
    got = {r["id"]: list(r["embedding"]) for r in models.embed(rows, "id", letters, batch=2).collect()}
    assert got[3] == [0, 0, 1] and got[2] == [0, 0, 0] and got[1] == pytest.approx([2 / 5**0.5, 1 / 5**0.5, 0])


def test_expansion_survives_a_failing_model(spark):
    def client():
        def ask(prompt):
            assert prompt.endswith("Output:")
            if "price of rent" in prompt:
                raise OSError("no model")
            return "1. how much is the fee\nWHAT IS THE FEE"

        return ask

    rows = spark.createDataFrame([(1, "what is the fee"), (2, "fee amount"), (3, "the price of rent")], "query_id int, question string")
    got = [(r["query_id"], r["variant"], r["text"]) for r in models.expand(rows, client).orderBy("query_id", "variant").collect()]
    assert got == [(1, 0, "what is the fee"), (1, 1, "how much is the fee"), (2, 0, "fee amount"), (3, 0, "the price of rent")]


def test_retrieval_from_texts_with_a_cross_encoder(spark):
    def scorer():
        return lambda pairs: [float(len(t)) for _, t in pairs]

    def blind():
        return lambda pairs: [-9.0 for _ in pairs]

    table = chunks(spark, ["alpha beta gamma", "alpha", "beta beta longer text here", "gamma words", "other cabbage", "zebra bacca"])
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "  ")], "query_id int, question string")
    r = asking(table, asked, letters, scorer=scorer)
    got = [(x["query_id"], x["rerank_score"], len(x["text"])) for x in r.reranked.orderBy("rerank_rank").collect()]
    assert got and all(q == 1 and s == n for q, s, n in got) and [s for _, s, _ in got] == sorted((s for _, s, _ in got), reverse=True)
    assert {"vector_hits", "lexical_hits", "fused", "reranked"} <= set(r.elapsed_ms) and all(ms >= 0 for ms in r.elapsed_ms.values())
    kept = asking(table, asked, letters, scorer=blind).reranked.collect()
    assert kept and all(x["rerank_score"] == x["score"] for x in kept)  # a blind model leaves the retrieval's scores


def test_responses_of_refused_and_empty_queries(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    gated = spark.createDataFrame([(1, True), (2, False)], "query_id int, answered boolean")
    said = spark.createDataFrame([(1, "yes", 7), (2, "never shown", 7)], "query_id int, answer string, total_tokens long")
    got = {r["query_id"]: (r["status"], r["answer"], r["total_tokens"]) for r in answering.responses(asked, gated, said).collect()}
    assert got == {1: ("answered", "yes", 7), 2: ("refused", answering.REFUSAL, 0), 3: ("empty", answering.NOTHING_FOUND, 0)}


def test_generate_asks_again(spark, tmp_path):
    log = tmp_path / "asked"

    def client():
        def ask(messages):
            with open(log, "a") as f:
                f.write("x")
            if len(log.read_text()) < 3:
                raise TimeoutError
            return {"answer": "a", "model": "m"}

        return ask

    rows = spark.createDataFrame([(1, [("user", "q")])], "query_id int, messages array<struct<role:string,content:string>>").coalesce(1)
    assert [r["answer"] for r in answering.generate(rows, client, wait=0.0).collect()] == ["a"] and log.read_text() == "xxx"


def test_scores_are_rounded_as_their_exact_values(spark):
    draw = random.Random(7)
    values = [n / 10_000 for n in range(-600, 12_000, 5)] + [draw.uniform(-2, 2) for _ in range(2000)] + [0.0, 0.0625, 0.1875, 1.0005, 0.1235, 12345.6785]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", answering.shown_score(F.col("x")).alias("r")).collect()
    assert all(r["r"] == round(r["x"], 3) for r in rows)


def test_sources_are_ranked(spark):
    rows = spark.createDataFrame([(1, 1, 5, 0.9001, "a"), (1, 2, 6, 0.9002, "b"), (1, 3, 5, 0.5, "c"), (1, 4, 7, 0.95, "d")], "query_id int, rerank_rank int, document_id int, rerank_score double, text string").withColumn("page_num", F.lit(1))
    got = [(r["document"], r["rank"]) for r in answering.sources(rows).orderBy("rank").collect()]
    assert got == [(7, 1), (5, 2), (6, 3)]  # 5 and 6 are shown alike, the earlier one stays first


def test_filters_by_folder_and_document(spark):
    table = chunks(spark, ["alpha one", "alpha two", "alpha three", "other", "words", "more", "filler", "rest"])
    asked = spark.createDataFrame([(1, "alpha", "x", None), (2, "alpha", "", "1"), (3, "alpha", "x", "0"), (4, "alpha", None, "")], "query_id int, text string, folder string, document string")
    found = lambda rows: {q: {r["chunk_id"] for r in rows if r["query_id"] == q} for q in (1, 2, 3, 4)}
    got = found(lexical.search(table, asked, 9).collect())
    assert got == {1: {"k0", "k2"}, 2: {"k2"}, 3: {"k0"}, 4: {"k0", "k1", "k2"}}
    vectors = table.select("chunk_id", "folder", "document_id", F.array(F.lit(1.0), F.col("chunk_index").cast("double")).alias("embedding"))
    by_vector = found(dense.search(vectors, asked.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))), 9, "chunk_id", "folder", "document_id").collect())
    assert by_vector == {1: {"k0", "k2", "k4", "k6"}, 2: {"k2", "k3"}, 3: {"k0"}, 4: {f"k{i}" for i in range(8)}}


def test_highlight_offset(spark):
    rows = spark.createDataFrame([("One  Two\nthree", "two three"), ("abc", "x"), ("abc", " "), ("", "a")], "t string, a string")
    assert [r[0] for r in rows.select(T.found_at(F.col("t"), F.col("a"))).collect()] == [4, -1, -1, -1]


def test_stream_takes_each_text_once_over_batches(spark, tmp_path):
    text = "A sentence that is repeated often enough to make a chunk. " * 4
    seen = []
    for n, docs in enumerate(([(1, text), (2, text)], [(3, text), (4, text + "More.")], [(5, text + "More.")])):
        spark.createDataFrame([(i, t, "f", "") for i, t in docs], "document_id long, text string, filename string, folder string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), then=lambda rows, number: seen.append((number, rows.select("document_id").distinct().count()))).awaitTermination()
    assert sorted({r["document_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}) == [1, 4]
    assert seen == [(0, 1), (1, 1), (2, 0)]


def test_delete_everywhere_keeps_the_registry_on_failure(spark, tmp_path):
    at = {n: catalog.Store(spark, str(tmp_path / n)) for n in ("chunks", "hashes", "registry")}
    for s in at.values():
        s.write(spark.createDataFrame([(1,), (2,)], "document_id long"))
    gone = spark.createDataFrame([(2,)], "document_id long")
    broken = catalog.Store(spark, str(tmp_path / "none"))
    with pytest.raises(RuntimeError, match="broken"):
        catalog.delete_everywhere({"broken": broken, "chunks": at["chunks"]}, at["registry"], gone)
    assert at["registry"].read().count() == 2 and at["chunks"].read().count() == 1
    catalog.delete_everywhere({"chunks": at["chunks"], "hashes": at["hashes"]}, at["registry"], gone)
    assert all([r[0] for r in s.read().collect()] == [1] for s in at.values())


def test_registry_rename(spark):
    table = spark.createDataFrame([("a",), ("b",)], "name string")
    names = lambda t: sorted(r[0] for r in t.collect())
    assert names(catalog.rename_registered(table, "a", " c ")) == ["b", "c"] and names(catalog.rename_registered(table, "a", "b")) == ["b"]
    with pytest.raises(ValueError):
        catalog.rename_registered(table, "a", " ")


def test_snapshots(spark, tmp_path):
    store, folder = catalog.Store(spark, str(tmp_path / "t")), str(tmp_path / "s")
    assert store.expire(folder) == []
    store.write(spark.range(3))
    made = store.snapshot(folder)
    store.write(spark.range(1))
    old = tmp_path / "s" / "2020-01-01-00-00-00-abc.snapshot"
    old.mkdir()
    assert store.expire(folder) == [old.name] and not old.exists()
    store.restore(made)
    assert store.read().count() == 3


def test_pdf_metadata(spark, tmp_path):
    from sedgewren.sources.documents import pdf_pages

    (tmp_path / "x.pdf").write_bytes(b"one|two")
    parse = lambda: lambda data: (data.decode().split("|"), {"title": "T", "creator": "C"})
    rows = pdf_pages(spark, str(tmp_path), parse).orderBy("page_num").collect()
    assert [(r["title"], r["author"], r["subject"], r["creator"], r["page_num"], r["char_count"]) for r in rows] == [("T", "Unknown", "", "C", 1, 3), ("T", "Unknown", "", "C", 2, 3)]


def test_only_candidates_are_cut_into_tokens_for_reranking(spark):
    r = _fixture(spark, "/root/testdata/sf0.001")
    assert r.reranked.count() > 0
    assert r.n_rows["texts"] == r.candidates.select("chunk_id").distinct().count() < r.chunks.count()
