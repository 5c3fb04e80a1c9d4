"""Hand-made cases of the retrieval rules, and plain-Python models of them."""

import hashlib

import re

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from sedgewren.functions import text as T
from sedgewren.operators import answering, catalog, dense, fusion, lexical, reranking
from sedgewren.operators.chunking import chunk_pages
from sedgewren.streaming.ingest import ingest, messages, page_stream


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def model_chunks(text, size=512, overlap=50, least=100):
    if len(text) < least:
        return []
    parts, n, out = [], 0, []
    for s in [s for s in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", text).strip()) if s]:
        if parts and n + len(s) > size:
            whole = " ".join(parts).strip()
            out += [whole] * (len(whole) >= least)
            parts, n = [whole[-overlap:], s], len(whole[-overlap:]) + len(s)
        else:
            parts, n = [*parts, s], n + len(s)
    whole = " ".join(parts).strip()
    return out + [whole] * (len(whole) >= least)


def test_tokens(spark):
    assert one(spark, T.search_tokens(F.col("t")), t="и не договоры Étion") == ["договоры", "tion"]
    assert one(spark, T.rerank_tokens(F.col("t")), t="договор the Agreement payments") == ["agree", "payment"]
    assert one(spark, T.search_tokens(F.col("t")), t="the of") == []


def test_normalization_takes_unicode_blanks(spark):
    assert one(spark, T.normalized(F.col("t")), t=" a b\x1cc \n") == "a b c"


def test_excerpt_and_anchor(spark):
    assert one(spark, T.excerpt(F.col("t")), t=" a\nb ") == "a b"
    assert one(spark, T.excerpt(F.col("t")), t="x" * 200) == "x" * 150 + "…"
    assert one(spark, T.highlight_anchor(F.col("t")), t="ab " + "x" * 200) == ("ab " + "x" * 200)[:120]
    assert one(spark, T.highlight_anchor(F.col("t")), t="word " * 50).endswith("word")


def test_chunks_match_the_model(spark):
    words = ["Alpha.", "beta", "gamma!", "delta? ", "x" * 300 + ".", " ", "\n"]
    texts = [" ".join(words[(i * j) % len(words)] for j in range(i * 7)) for i in range(40)] + ["", "short", "y" * 700]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "document_id long, page_num int, text string")
    got = {}
    for r in chunk_pages(pages).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append(r["text"])
    assert got == {i: c for i, t in enumerate(texts) if (c := model_chunks(t))}


def test_chunk_index_runs_over_pages(spark):
    page = "One sentence of a page that is long enough to be kept as a chunk of its own, which takes a hundred signs."
    pages = spark.createDataFrame([(1, 2, page), (1, 1, page), (1, 3, "short")], "document_id long, page_num int, text string")
    assert [(r["chunk_id"]) for r in chunk_pages(pages).orderBy("chunk_index").collect()] == ["1_p1_c0", "1_p2_c1"]


def test_bm25_of_one_chunk_finds_nothing(spark):
    chunks = spark.createDataFrame([("c", 1, 0, "", "alpha beta")], "chunk_id string, document_id long, chunk_index int, folder string, text string")
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, text string")
    assert lexical.search(chunks, asked, 5).count() == 0


def test_bm25_normalizes_within_the_folder(spark):
    rows = [(f"c{i}", i, 0, "a" if i < 5 else "b", "alpha " * (i + 1) + "filler words here") for i in range(3)] + [(f"d{i}", 10 + i, 0, "b", "other words") for i in range(9)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id long, chunk_index int, folder string, text string")
    asked = spark.createDataFrame([(1, "alpha", "a"), (2, "alpha", "b"), (3, "the", "a")], "query_id int, text string, folder string")
    got = lexical.search(chunks, asked, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in got] == [(1, "c2", 1), (1, "c1", 2)] and got[0]["score"] == 1.0


def test_fold_is_ordered_and_clamped(spark):
    hits = spark.createDataFrame(
        [(1, 0, "vector", 1, "a", -0.4), (1, 0, "bm25", 1, "a", 1.0), (1, 1, "bm25", 1, "a", 1.0), (1, 0, "bm25", 2, "b", 0.9), (1, 1, "bm25", 2, "b", 0.9), (1, 1, "vector", 1, "c", 1.2)],
        "query_id int, variant int, source string, rank int, chunk_id string, score double",
    )
    got = {r["chunk_id"]: (round(r["score"], 6), r["source"]) for r in fusion.fuse_variants(hits).collect()}
    assert got == {"a": (0.075, "hybrid"), "b": (1.0, "bm25"), "c": (1.08, "vector")}
    strict = {r["chunk_id"]: r["source"] for r in fusion.fuse_variants(hits, strict_compat=True).collect()}
    assert strict == {"a": None, "b": "bm25", "c": None}


def test_neighbors_guarantee_and_gate(spark):
    chunks = spark.createDataFrame([(f"{d}{i}", d, i) for d in "xy" for i in range(4)], "chunk_id string, document_id string, chunk_index int")
    fused = spark.createDataFrame([(1, "x1", 0.9, "bm25", 1), (1, "x3", 0.5, "bm25", 2), (1, "y0", 0.1, "vector", 3)], "query_id int, chunk_id string, score double, source string, ord long")
    out = fusion.expand_neighbors(fused, chunks, bases=2)
    got = {r["chunk_id"]: (round(r["score"], 6), r["source"]) for r in out.collect()}
    assert got == {"x1": (0.9, "bm25"), "x3": (0.5, "bm25"), "y0": (0.1, "vector"), "x0": (0.54, "neighbor"), "x2": (0.54, "neighbor")}
    kept = fusion.guarantee_documents(out, chunks, k=2)
    assert {r["chunk_id"] for r in kept.collect()} == {"x1", "x0", "y0"}
    assert [(r["best"], r["answered"]) for r in fusion.gate(kept).collect()] == [(0.9, True)]


def test_language_fallback(spark):
    rows = spark.createDataFrame([(1, "a", -11.0, 0.4), (1, "b", -10.0, 0.2), (2, "c", -9.0, 0.4), (2, "d", 1.0, 0.1)], "query_id int, chunk_id string, m double, score double")
    got = {r["chunk_id"]: r["s"] for r in rows.withColumn("s", reranking.with_fallback(F.col("m"), F.col("score"))).collect()}
    assert got == {"a": 0.4, "b": 0.2, "c": -9.0, "d": 1.0}


def test_context_is_empty_if_the_first_entry_is_too_long(spark):
    rows = spark.createDataFrame([(1, 1, "z" * 12_001, 1, "f"), (1, 2, "ok", 1, "f"), (2, 1, "ok", 3, "f"), (2, 2, "ok2", 4, "g")], "query_id int, rerank_rank int, text string, page_num int, filename string")
    got = {r["query_id"]: r["context"] for r in answering.contexts(rows).collect()}
    assert got == {1: "", 2: "[f | Page 3]\nok\n\n[g | Page 4]\nok2"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=7))
def test_history(spark, sizes):
    recent = sizes[-4:]
    while sum(recent) > 8000 and len(recent) >= 2:
        recent = recent[2:]
    rows = spark.createDataFrame([([("user", "x" * n) for n in sizes],)], "h array<struct<role:string,content:string>>")
    got = rows.select(answering.trimmed_history(F.col("h")).alias("h")).first()["h"]
    assert [len(t["content"]) for t in got] == recent


def test_variants(spark):
    rows = spark.createDataFrame([(1, "what is the rent", "1. the rent amount\nWHAT IS THE RENT\nabc\n- The Rent Amount\n2) price"), (2, "rent price", "a b c d"), (3, "what is the rent", None)], "query_id int, question string, answer string")
    got = [(r["query_id"], r["variant"], r["text"]) for r in answering.variants(rows).orderBy("query_id", "variant").collect()]
    assert got == [(1, 0, "what is the rent"), (1, 1, "the rent amount"), (1, 2, "price"), (2, 0, "rent price"), (3, 0, "what is the rent")]


def test_store_keeps_whole_versions(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path / "t"))
    store.create("name string")
    store.create("name string")
    assert store.info() == {"points": 0}
    store.write(catalog.create_folder(store.read(), "A"))
    assert [r[0] for r in store.read().collect()] == ["A"]


def test_stream_ingests_each_text_once(spark, tmp_path):
    text = "A sentence that is repeated often enough to make a chunk. " * 4
    docs = spark.createDataFrame([(1, text, "a", ""), (2, text, "b", ""), (3, text + "More.", "c", "f")], "document_id long, text string, filename string, folder string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert len({r["document_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}) == 2


def test_channel_messages(spark):
    rows = spark.createDataFrame([(1, " hi "), (2, "/start"), (3, " "), (4, None)], "chat_id int, text string")
    assert [(r["chat_id"], r["question"], r["top_k"]) for r in messages(rows).collect()] == [(1, "hi", 3)]


def test_zero_vectors_take_no_part(spark, monkeypatch):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)] + [(9, [0.0, 0.0])], "query_id long, vector array<double>")
    once = sorted(map(tuple, dense.search(vectors, asked, 2).collect()))
    assert [r[:2] for r in once if r[0] == 0] == [(0, 1), (0, 3)] and not [r for r in once if r[1] == 2 or r[0] == 9]
    monkeypatch.setattr(dense, "SENT", 100)  # queries in blocks
    assert sorted(map(tuple, dense.search(vectors, asked, 2).collect())) == once


def test_pdf_pages_of_equal_names(spark, tmp_path):
    from sedgewren.sources.documents import pdf_pages

    for folder, text in (("a", b"first|"), ("b", b"second file, whose only page is long enough to need no OCR at all")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.pdf").write_bytes(text)
    rows = pdf_pages(spark, str(tmp_path), lambda: lambda data: data.decode().split("|"), lambda: lambda data, n: "seen" if n == 2 else " ").orderBy("path", "page_num").collect()
    got = [(r["path"][-7:], r["hash"], r["page_num"], r["page_count"], r["text"], r["has_ocr"]) for r in rows]
    a, b = (hashlib.md5((tmp_path / f / "x.pdf").read_bytes()).hexdigest() for f in "ab")
    assert got == [("a/x.pdf", a, 1, 2, "", True), ("a/x.pdf", a, 2, 2, "seen", True), ("b/x.pdf", b, 1, 1, "second file, whose only page is long enough to need no OCR at all", False)]


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path / "t"))
    for n in range(4):
        store.write(spark.range(n + 1))
    with pytest.raises(Exception):  # noqa: B017
        store.write(spark.range(3).select(F.raise_error(F.lit("crash"))))
    assert store.read().count() == 4 and store.exists()
    store.create(spark.range(1).schema)
    assert store.read().count() == 4
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) <= 3


def test_copies_of_a_vector_leave_a_task_as_the_pools_first(spark):
    table = spark.range(0, 30_000, 1, 1).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vector array<double>").withColumn("qn", F.lit(5**0.5))
    rows = table.orderBy(F.desc("vec_id")).coalesce(1).select("vec_id", F.col("embedding").alias("v"), F.lit(5**0.5).alias("vn"))
    assert dense._every_pair(rows, asked.withColumnRenamed("vector", "q"), "vec_id", 7).count() < 30_000 / 10
    assert [r["vec_id"] for r in dense.search(table, asked.drop("qn"), 7).orderBy("rank").collect()] == list(range(7))
