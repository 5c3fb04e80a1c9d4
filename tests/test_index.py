"""The stored indexes: posting layout and bounds, segments, and vector cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewren.operators import dense, lexical
from sedgewren.operators.cells import Cells
from sedgewren.operators.segments import SegmentedIndex
from sedgewren.plans import catalogue, retrieve
from sedgewren.sources.stage import small, staged
from sedgewren.streaming.ingest import ingest, page_stream

CHUNKS = "chunk_id string, document_id long, chunk_index int, folder string, text string"


def corpus(spark, n, seed=1, first=0, words=300):
    """Chunks of words of which few are frequent; every fifth text is a copy of the one before."""
    draw, rows = random.Random(seed), []
    for i in range(first, first + n):
        text = rows[-1][4] if i % 5 == 0 and rows else " ".join(f"word{int(words * draw.random() ** 3)}" for _ in range(draw.randint(0, 40)))
        rows.append((f"c{i}", i // 3, i % 3, "ab"[i % 2], text))
    return spark.createDataFrame(rows, CHUNKS)


def asked(spark, n=12, seed=2, words=300):
    draw = random.Random(seed)
    rows = [(q, " ".join(f"word{int(words * draw.random() ** 2)}" for _ in range(draw.randint(1, 7))), draw.choice([None, "", "a"]), draw.choice([None, None, "7"])) for q in range(n)]
    return spark.createDataFrame(rows, "query_id int, text string, folder string, document string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def scans(spark, df):
    """Bytes of files and rows of every scan of a query, as it ran."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        plan, out = df._jdf.queryExecution().executedPlan(), []
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            metrics, name = leaves.apply(i).metrics(), leaves.apply(i).nodeName()
            if name.startswith("Scan parquet"):
                out.append((metrics.get("filesSize").get().value(), metrics.get("numOutputRows").get().value()))
        return out
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bounds_change_no_result(spark, monkeypatch):
    chunks, queries = staged(corpus(spark, 900), "corpus"), asked(spark)
    for some in (queries.select("query_id", "text"), queries):
        want = rows(lexical.search(chunks, some, 10))
        with monkeypatch.context() as m:
            m.setattr(lexical, "WINDOW", 20)
            m.setattr(lexical, "MANY", 1)
            m.setattr(lexical, "LISTED", 2)  # of more terms only the buckets are named
            assert lexical.indexed(chunks).windows == 45
            assert rows(lexical.search(chunks, some, 10)) == want


def test_bounds_leave_windows_out(spark, monkeypatch):
    rare = [(f"r{i}", 5000 + i, 0, "a", "needle word1") for i in range(12)]
    chunks = staged(corpus(spark, 900).unionByName(spark.createDataFrame(rare, CHUNKS)), "corpus")
    monkeypatch.setattr(lexical, "WINDOW", 20)
    index = lexical.indexed(chunks)
    queries = spark.createDataFrame([(1, "needle word1 word2")], "query_id int, text string")
    weights, only, _ = lexical._asked(index, queries)
    used = {}
    real = lexical.placed

    def placed(index, asked, only, windows=None):
        used[len(used)] = windows.count()
        return real(index, asked, only, windows)

    monkeypatch.setattr(lexical, "placed", placed)
    monkeypatch.setattr(lexical, "SEEDS", 8)
    got = rows(lexical.ranked(lexical.bounded(index, weights, only, 3), 3))
    assert used[0] == 8 and used[0] + used[1] < index.windows / 2
    assert got == rows(lexical.ranked(real(index, weights, only), 3))


def test_bytes_follow_the_asked_terms(spark, monkeypatch):
    """In a corpus eight times as large, a search for terms that occur as often reads as much."""
    monkeypatch.setattr(lexical, "BUCKET", 100)
    monkeypatch.setattr(lexical, "GROUP", 4096)
    read = []
    for n in (800, 6400):
        rows_ = [(f"c{i}", i, 0, "a", " ".join(f"term{(i * 37 + j * 11) % n}" for j in range(30)) + (" needle" if i < 20 else "")) for i in range(n)]
        index = lexical.indexed(staged(spark.createDataFrame(rows_, CHUNKS), "corpus"))
        weights, only, _ = lexical._asked(index, spark.createDataFrame([(1, "needle")], "query_id int, text string"))
        whole = sum(f for f, _ in scans(spark, index.postings.select("document_id")))
        ((size, seen),) = [x for x in scans(spark, index.postings.where(only).select("document_id", "term"))]
        read.append((size, seen, whole))
    (small_size, small_rows, small_whole), (large_size, large_rows, large_whole) = read
    assert large_whole > 4 * small_whole and large_size < 2 * small_size and large_size < large_whole / 20
    plan = index.postings.where(only)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "term" in plan[plan.index("PushedFilters") :].split("]")[0]


def test_row_groups_of_other_terms_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP", 4096)
    texts = [(f"c{i}", i, 0, "a", " ".join(f"term{(i * 37 + j * 11) % 3000}" for j in range(40))) for i in range(3000)]
    index = lexical.indexed(staged(spark.createDataFrame(texts, CHUNKS), "corpus"))
    _, only, _ = lexical._asked(index, spark.createDataFrame([(1, "term7")], "query_id int, text string"))
    ((_, seen),) = scans(spark, index.postings.where(only).select("document_id", "term"))
    assert 0 < seen < index.postings.count() / 10


def test_one_scan_of_the_postings(spark):
    index = lexical.indexed(staged(corpus(spark, 300), "corpus"))
    df = lexical.search(None, asked(spark).select("query_id", "text"), 5, index)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the best score and the ranks come from one exchange; the second reader names it, and has no scan of its own
    assert "ReusedExchange" in final and final.count("stage-postings") == 1


def test_segments_equal_a_rebuilt_index(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, str(tmp_path / "i"), buckets=3)
    with pytest.raises(ValueError, match="no index"):
        index.index()
    index.delete(spark.createDataFrame([(1,)], "document_id long"))
    live, draw = {}, random.Random(5)
    for step in range(6):
        new = corpus(spark, 30, seed=step, first=step * 30)
        index.add(new, f"b{step}")
        index.add(new, f"b{step}")  # again, as after a failure
        live.update({r["chunk_id"]: tuple(r) for r in new.collect()})
        gone = {draw.randrange((step + 1) * 10) for _ in range(3)}
        index.delete(spark.createDataFrame([(g,) for g in gone] + [(None,), (99_999,)], "document_id long"))
        live = {k: v for k, v in live.items() if v[1] not in gone}
        if step % 3 == 2:
            assert index.merge() >= (step > 3)
    # a document comes back with another text
    back = [(f"n{i}", 3, i, "a", "word1 again and again") for i in range(2)]
    index.add(spark.createDataFrame(back, CHUNKS))
    live.update({r[0]: r for r in back})
    assert len(index._segments()) < 7
    rebuilt = lexical.indexed(staged(spark.createDataFrame(list(live.values()), CHUNKS), "corpus"))
    # a new session's view, which must not tokenize any chunk
    monkeypatch.setattr(lexical, "occurrences", None)
    opened = SegmentedIndex(spark, str(tmp_path / "i"), buckets=3)
    whole = opened.index()
    assert (whole.chunks, whole.tokens) == (rebuilt.chunks, rebuilt.tokens)
    number = lambda t: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in t.collect())
    assert number(whole.statistics()) == number(rebuilt.statistics())
    queries = asked(spark)
    assert rows(opened.search(queries, 10)) == rows(lexical.search(None, queries, 10, rebuilt))
    before = rows(opened.search(queries, 10))
    assert opened.vacuum() and opened.vacuum() == [] and rows(opened.search(queries, 10)) == before


def test_empty_chunks_count_in_a_segment(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(spark.createDataFrame([("a", 1, 0, "", "alpha beta"), ("b", 2, 0, "", "the of"), ("c", 3, 0, "", "gamma")], CHUNKS))
    whole = index.index()
    assert (whole.chunks, whole.tokens) == (3, 3)
    index.delete(spark.createDataFrame([(2,), (1,)], "document_id long"))
    assert (index.index().chunks, index.index().tokens) == (1, 1)
    assert [r["term"] for r in index.index().statistics().collect()] == ["gamma"]


def test_many_queries_of_a_segmented_index_read_no_postings(spark, tmp_path, monkeypatch):
    """Adding, deleting, merging and searches of many queries make no postings; results are those of an index built anew."""
    index = SegmentedIndex(spark, str(tmp_path / "i"), buckets=3)
    chunks = staged(corpus(spark, 400), "corpus")
    for n in range(4):
        index.add(chunks.where(F.pmod("document_id", F.lit(4)) == n), f"b{n}")
    gone = staged(chunks.where("document_id % 10 = 3").select("document_id"), "gone")
    monkeypatch.setattr("sedgewren.operators.segments.LISTED", 2)  # of more documents the ids are joined
    index.delete(gone)
    rebuilt = lexical.indexed(staged(chunks.where("document_id % 10 <> 3"), "corpus"))
    few = asked(spark)
    many = spark.range(3).select(F.col("id").cast("int").alias("copy")).crossJoin(few).select((F.col("copy") * 100 + F.col("query_id")).alias("query_id"), "text", "folder", "document")
    for k, v in {"SCORED": 64, "CELLS": 1, "HELD": 20, "SENT": 2000}.items():
        monkeypatch.setattr(lexical, k, v)
    for merged in (False, True):
        if merged:
            assert index.merge() == 1 and index._folder(index.state(), "tombstones").count() == 0
        assert rows(index.search(many, 10)) == rows(lexical.search(None, many, 10, rebuilt))
        number = lambda t: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in t.collect())
        assert number(index.statistics()) == number(rebuilt.statistics())
        assert {x.name.split("-")[0] for x in (tmp_path / "i").iterdir()} <= {"state", "forward", "tombstones", "vocabulary"}
    assert rows(index.search(few, 10)) == rows(lexical.search(None, few, 10, rebuilt))  # these do
    assert [x.name for x in (tmp_path / "i" / "postings").iterdir()] == ["segment=4"]
    files = {x for x in (tmp_path / "i" / "postings").rglob("*") if x.is_file()}
    index.search(few, 10).collect()
    assert {x for x in (tmp_path / "i" / "postings").rglob("*") if x.is_file()} == files  # once
    assert index.vacuum() and rows(index.search(few, 10)) == rows(lexical.search(None, few, 10, rebuilt))


def test_a_segment_without_a_term(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "i"), buckets=2)
    texts = [("a", 1, 0, "", "the of"), ("b", 2, 0, "", None), ("c", 3, 0, "", "")]
    index.add(spark.createDataFrame(texts, CHUNKS))
    assert (index.index().chunks, index.index().tokens) == (3, 0) == (lexical.indexed(staged(spark.createDataFrame(texts, CHUNKS), "corpus")).chunks, 0)
    one, many = (spark.createDataFrame([(q, "alpha the") for q in range(n)], "query_id int, text string") for n in (1, 20))
    assert index.search(one, 5).count() == index.search(many, 5).count() == index.statistics().count() == 0
    index.add(spark.createDataFrame([("d", 4, 0, "", "alpha beta alpha")], CHUNKS))
    assert (index.index().chunks, index.index().tokens) == (4, 3)
    assert [r["chunk_id"] for r in index.search(one, 5).collect()] == ["d"] and index.search(many, 5).count() == 20


def test_registered_segment_queries_make_neither_vectors_nor_postings(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "_fixture", None)
    d = "/root/testdata/sf0.001/"  # of another name, so that nothing is kept for it
    assert catalogue.lexical_segments(spark, d).count() > 0 and catalogue.bm25_segments(spark, d).count() > 0
    index = catalogue._segmented(spark, d)
    assert index._names("forward") and not index._names("postings") + index._names("heads")


def test_the_stream_feeds_the_index(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "i"), buckets=2)
    sentence = "The {} report describes the matter at length, so that it makes a chunk of more than one hundred characters, surely."
    for n in range(4):
        docs = [(10 * n + i, sentence.format(f"alpha{n} beta{i}"), f"f{i}", "x") for i in range(3)]
        spark.createDataFrame(docs, "document_id long, text string, filename string, folder string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), then=index.append).awaitTermination()
    assert len(index._segments()) == 1 and index.index().chunks == 12
    found = index.search(spark.createDataFrame([(1, "alpha3")], "query_id int, text string"), 9).collect()
    assert sorted(r["document_id"] for r in found) == [30, 31, 32]


def vectors(spark, n=600, d=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (15, d))
    x = centres[rng.integers(0, 15, n)] + rng.normal(0, 0.25, (n, d))
    x[5] = x[6] = x[7]  # ties
    rows_ = [(i, "xy"[i % 2], i % 4, v.tolist()) for i, v in enumerate(x)] + [(n, "x", 0, [0.0] * d), (n + 1, "x", 0, None)]
    return spark.createDataFrame(rows_, "vec_id long, folder string, doc int, embedding array<double>")


def test_cells_give_what_every_vector_gives(spark, tmp_path):
    table = staged(vectors(spark), "vectors")
    index = Cells.build(table.where("vec_id < 400"), str(tmp_path / "c"), cells=12)
    index.add(table.where("vec_id >= 400"))  # new vectors widen the cells
    queries = table.where("vec_id % 20 = 5 or vec_id = 600").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 40 == 5, F.col("folder")).alias("folder"), F.lit("").alias("document"))
    plain = queries.select("query_id", "vector")
    assert rows(index.search(plain, 7)) == rows(dense.search(table, plain, 7))
    assert rows(index.search(queries, 7, folder="folder", document="doc")) == rows(dense.search(table, queries, 7, folder="folder", document="doc").select("query_id", "vec_id", "score", "rank"))
    assert rows(index.search(plain, 2000)) == rows(dense.search(table, plain, 2000))  # more than there are
    every = index.vectors().select("cell").distinct().count()
    near = index.nearest_cells(plain).where("place <= 2")
    scored = index._scored(staged(near.where("query_id = 25"), "probes"), "vec_id", [])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert every > 4 and sum(s for s, _ in scans(spark, scored)) < 0.6 * sum(s for s, _ in scans(spark, index.vectors()))


def test_cells_hand_on_the_best_of_a_batch(spark, tmp_path):
    table = staged(vectors(spark, 1500), "vectors")
    index = Cells.build(table, str(tmp_path / "c"), cells=4)
    near = staged(index.nearest_cells(table.where("vec_id % 20 = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))), "cells")
    every, best = index._scored(near, "vec_id", []), index._scored(near, "vec_id", [], 3)
    assert every.count() == 75 * 1500 and best.count() < 75 * 1500 / 4
    assert rows(index._ranked(best, "vec_id", 3)) == rows(index._ranked(every, "vec_id", 3))


def test_recall_of_few_cells(spark):
    want = {tuple(r)[:2] for r in catalogue.queries()["cosine_topk"](spark, "/root/testdata/sf0.01").collect()}
    rows_ = catalogue.queries()["cosine_cells_topk"](spark, "/root/testdata/sf0.01").collect()
    got = {(r["query_id"], r["vec_id"]) for r in rows_}
    assert len(got & want) >= 0.9 * len(want)
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in catalogue.queries()["cosine_topk"](spark, "/root/testdata/sf0.01").collect()}
    assert all(exact[r["query_id"], r["vec_id"]] == r["score"] for r in rows_ if (r["query_id"], r["vec_id"]) in exact)


def test_recall_in_clustered_vectors(spark, tmp_path):
    table = staged(vectors(spark, 1500), "vectors")
    index = Cells.build(table, str(tmp_path / "c"), cells=16)
    queries = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    want = pairs(dense.search(table, queries, 30))
    assert len(pairs(index.search(queries, 30, probes=4)) & want) >= 0.9 * len(want)


def test_small_tables_are_spread_and_others_not(spark, tmp_path, monkeypatch):
    from sedgewren.sources import stage

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(20).write.parquet(str(tmp_path / "many"))
    shuffled = lambda name: "Exchange" in stage.spread(spark.read.parquet(str(tmp_path / name)), str(tmp_path / name), "id")._jdf.queryExecution().executedPlan().toString()
    assert shuffled("one") and not shuffled("many")
    monkeypatch.setattr(stage, "SHARE", 1)
    assert not shuffled("one")


def test_arrays_count_for_broadcasts(spark):
    rows = spark.range(10).selectExpr("id", "sequence(0, 999) as v")
    assert "BroadcastExchange" in _plan(rows.select("id"), small(rows, 100_000))
    assert "BroadcastExchange" not in _plan(rows.select("id"), small(rows, 50_000))
    assert "BroadcastExchange" in _plan(rows.select("id"), small(rows.selectExpr("id", "cast(null as array<int>) as v"), 50_000))


def _plan(left, right):
    left.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return left.join(right, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        left.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_leaves_a_share_does_not_grow_with_its_hits(spark, monkeypatch):
    """Chunks that a query hits stay in their share but for the pool's best, of equal ones the first; nothing grows with queries times chunks."""
    monkeypatch.setattr(lexical, "FEW", 1)
    texts = [(f"c{i}", i, 0, "ab"[i % 2], f"common same{i % 3} " + "pad " * (i % 2)) for i in range(6000)]
    index = lexical.indexed(staged(spark.createDataFrame(texts, CHUNKS), "corpus"))
    some = [(q, f"common same{q % 3}", "a" if q % 2 else None, str(q) if q % 5 == 4 else None) for q in range(20)]
    queries = spark.createDataFrame(some, "query_id int, text string, folder string, document string")
    weights, only, _ = lexical._asked(index, queries)
    for turns in (1 << 20, 500):  # at once, and in several turns
        monkeypatch.setattr(lexical, "SENT", turns)
        left = lexical.scored(index, weights, only, 7)
        shares = max(2 * spark.sparkContext.defaultParallelism, 1)
        assert left.count() <= 20 * shares * 2 * 7
        want = rows(lexical.ranked(lexical.placed(index, weights, only), 7))
        assert rows(lexical.ranked(left, 7)) == want and len(want) > 100


def test_search_of_texts_equals_search_of_postings(spark, monkeypatch):
    """Without postings, with equal scores, filters, nulls, several turns, small blocks and results handed on in between."""
    chunks = corpus(spark, 900).unionByName(spark.createDataFrame([(f"e{i}", 4000 + i, 0, "a", t) for i, t in enumerate([None, "", "the of", "Word1 İword2 WORD3s wörd ёлка ёлки"])], CHUNKS))
    chunks = staged(chunks.repartition(3), "corpus")
    more = spark.createDataFrame([(100, "ёлка words", None, None), (101, "the", None, None), (102, "word1 word2", "b", "4003"), (103, "word0 word1 word2", "z", None)], "query_id int, text string, folder string, document string")
    index, texts = lexical.indexed(chunks), lexical.counted(chunks)
    assert (texts.chunks, texts.tokens) == (index.chunks, index.tokens) == (904, index.tokens)
    number = lambda t: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in t.statistics().collect())
    assert number(texts) == number(index)
    some = asked(spark).unionByName(more)
    want = rows(lexical.search(None, some, 10, index))
    assert rows(lexical.search(None, some, 10, texts)) == want and len(want) > 25
    for k, v in {"SCORED": 64, "CELLS": 1, "HELD": 20, "SENT": 2000}.items():
        monkeypatch.setattr(lexical, k, v)
    assert rows(lexical.search(None, some, 10, texts)) == want
    # of equal chunks a task hands on the first ones only
    same = staged(spark.createDataFrame([(f"c{i}", i, 0, "a", f"same words w{i}") for i in range(5000)], CHUNKS).repartition(2), "corpus")
    texts = lexical.counted(same)
    weights, only, _ = lexical._asked(texts, spark.createDataFrame([(q, "same") for q in range(20)], "query_id int, text string"))
    left = lexical.scored(texts, weights, only, 7)
    assert left.count() <= 20 * 7 * 2 and sorted({r["document_id"] for r in lexical.ranked(left, 7).collect()}) == list(range(7))
