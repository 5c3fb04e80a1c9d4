"""Kept model results, rectangles, chats, keyed rows and timings."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewren.functions.text import found_at
from sedgewren.operators import highlights, models
from sedgewren.operators.keyed import KeyedStore
from sedgewren.operators.kept import Results, embedded, expansions, generated, scored
from sedgewren.plans.retrieve import Retrieval
from sedgewren.streaming.chats import all_questions, questions


def calls(path) -> int:
    return len(path.read_text().split()) if path.exists() else 0


def test_a_second_run_calls_no_model(spark, tmp_path):
    log = tmp_path / "calls"

    def encoder():
        def encode(texts):
            with open(log, "a") as f:
                f.write("x " * len(texts))
            return [[len(t), 1.0] for t in texts]

        return encode

    kept = Results(spark, str(tmp_path / "kept"), "letters", "array<double>", batch=3)
    rows = spark.createDataFrame([(i, ["one", "three", None, "", "one"][i % 5]) for i in range(40)], "chunk_id int, text string").repartition(4)
    want = {r["chunk_id"]: r["embedding"] for r in models.embed(rows, "chunk_id", lambda: lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    for _ in range(2):
        got = embedded(rows, "chunk_id", encoder, kept).collect()
        assert {r["chunk_id"]: list(r["embedding"]) for r in got} == {k: list(v) for k, v in want.items()} and all(r["error"] is None for r in got)
        assert calls(log) == 3  # one, three and the empty text
    more = rows.unionByName(spark.createDataFrame([(99, "fourteen")], "chunk_id int, text string"))
    assert embedded(more, "chunk_id", encoder, kept).count() == 41 and calls(log) == 4
    # another model's results are other results
    assert embedded(rows, "chunk_id", encoder, Results(spark, str(tmp_path / "kept"), "other", "array<double>")).count() == 40 and calls(log) == 7


def test_failed_calls_are_errors_and_asked_again(spark, tmp_path):
    broken, log = tmp_path / "broken", tmp_path / "calls"
    broken.write_text("")

    def scorer():
        def score(pairs):
            with open(log, "a") as f:
                f.write("x " * len(pairs))
            if broken.exists() and any("bad" in t for _, t in pairs):
                raise OSError("model is away")
            return np.array([float(len(t)) for _, t in pairs])

        return score

    kept = Results(spark, str(tmp_path / "kept"), "cross", "double", batch=8)
    pairs = spark.createDataFrame([(i, "q", t) for i, t in enumerate(["good", "bad", "also", "good"])], "n int, question string, text string").coalesce(1)
    got = {r["n"]: (r["model_score"], r["error"]) for r in scored(pairs, scorer, kept).collect()}
    assert got == {0: (4.0, None), 1: (None, "model is away"), 2: (4.0, None), 3: (4.0, None)}
    before = calls(log)
    broken.unlink()
    got = {r["n"]: (r["model_score"], r["error"]) for r in scored(pairs, scorer, kept).collect()}
    assert got[1] == (3.0, None) and calls(log) == before + 1


def test_expansions_and_answers_are_kept(spark, tmp_path):
    log = tmp_path / "calls"

    def client():
        def ask(prompt):
            with open(log, "a") as f:
                f.write("x ")
            if "rent" in prompt.split("Query:")[-1]:
                raise OSError("no model")
            return "1. how much is the fee\nWHAT IS THE FEE"

        return ask

    rows = spark.createDataFrame([(1, "what is the fee"), (2, "fee amount"), (3, "the price of rent"), (4, "what is the fee")], "query_id int, question string")
    kept = Results(spark, str(tmp_path / "kept"), "llm", batch=1)
    want = [(1, 0, "what is the fee"), (1, 1, "how much is the fee"), (2, 0, "fee amount"), (3, 0, "the price of rent"), (4, 0, "what is the fee"), (4, 1, "how much is the fee")]
    for n in (2, 3):  # the failed one is asked again
        assert [(r["query_id"], r["variant"], r["text"]) for r in expansions(rows, client, kept).orderBy("query_id", "variant").collect()] == want
        assert calls(log) == n

    def talker():
        def answer(messages):
            with open(log, "a") as f:
                f.write("x ")
            return {"answer": messages[-1]["content"].upper(), "model": "m", "prompt_tokens": 3, "completion_tokens": 4}

        return answer

    said = spark.createDataFrame([(1, [("user", "hi")]), (2, [("user", "ho")]), (3, [("user", "hi")])], "query_id int, messages array<struct<role:string,content:string>>")
    for _ in range(2):
        got = [tuple(r) for r in generated(said, talker, Results(spark, str(tmp_path / "said"), "llm", batch=1)).orderBy("query_id").collect()]
        assert got == [(1, "HI", "m", 3, 4, 7, None), (2, "HO", "m", 3, 4, 7, None), (3, "HI", "m", 3, 4, 7, None)] and calls(log) == 5


WORDS = "document_id long, page_num int, place int, line int, word string, x0 double, y0 double, x1 double, y1 double"


def page(document, number, text, width=4):
    return [(document, number, i, i // width, w, 10.0 * (i % width), 20.0 * (i // width), 10.0 * (i % width) + len(w), 20.0 * (i // width) + 9) for i, w in enumerate(text.split())]


def test_rectangles_of_every_hit(spark):
    words = spark.createDataFrame(page(1, 1, "The quick brown fox jumps over the Quick brown fox") + page(1, 2, "quick brown") + page(2, 1, "misquick brown foxes"), WORDS)
    asked = [("a", 1, 1, "quick  brown\nfox"), ("b", 1, 2, "quick brown"), ("c", 1, 3, "quick"), ("d", 1, 1, " "), ("e", 1, 1, "absent words"), ("f", 2, 1, "quick brown fox"), ("g", 1, 2, "row"), ("h", 1, 1, None)]
    anchors = spark.createDataFrame(asked, "chunk_id string, document_id long, page_num int, text string")
    got = sorted(tuple(r) for r in highlights.rectangles(words, anchors).collect())
    assert got == [
        ("a", 1, 1, 0, 10.0, 0.0, 33.0, 9.0),  # quick brown fox, on one line
        ("a", 1, 2, 1, 30.0, 20.0, 35.0, 29.0), ("a", 1, 2, 2, 0.0, 40.0, 13.0, 49.0),  # over two lines
        ("b", 2, 1, 0, 0.0, 0.0, 15.0, 9.0),
        ("f", 1, 1, 0, 0.0, 0.0, 25.0, 9.0),  # inside of words at both ends
        ("g", 2, 1, 0, 10.0, 0.0, 15.0, 9.0),
    ]


def test_offsets_of_a_page_take_one_row(spark):
    pages = spark.createDataFrame([(1, 1, "The  Quick\nbrown fox. ÜBER the fox"), (1, 2, "fox"), (2, 1, None)], "document_id long, page_num int, page string")
    asked = [("a", 1, 1, "quick brown"), ("b", 1, 1, "über"), ("c", 1, 1, " "), ("d", 1, 2, "quick"), ("e", 1, 2, None), ("f", 2, 1, "x"), ("g", 3, 1, "x"), ("h", 1, 1, "THE FOX")]
    anchors = spark.createDataFrame(asked, "chunk_id string, document_id long, page_num int, anchor string")
    got = {r["chunk_id"]: (r["at"], r["n_chars"]) for r in highlights.offsets(pages, anchors).collect()}
    want = anchors.join(pages, ["document_id", "page_num"]).select("chunk_id", found_at(F.col("page"), F.col("anchor")).alias("at"), F.length("anchor").alias("n"))
    assert got == {r["chunk_id"]: (r["at"], r["n"]) for r in want.collect()} and got["a"] == (4, 11) and got["b"] == (21, 4)


def chat_rows(seed=3, n=120):
    draw, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        text = draw.choice(["", " ", "/start", f"turn {i}", "long " * draw.choice([3, 900])])
        rows.append((f"c{draw.randrange(4)}", start + datetime.timedelta(minutes=i), draw.choice(["user", "assistant"]), text))
    return rows


TURNS = "chat_id string, at timestamp, role string, text string"


def run_chats(spark, tmp_path, batches, **options):
    got = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = questions(spark.readStream.schema(TURNS).parquet(str(tmp_path / "in")), **options)
        keep = lambda batch, number: got.extend(tuple(map(str, r)) for r in batch.collect())
        stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return got


def test_chats_equal_the_whole_table(spark, tmp_path):
    rows = chat_rows()
    batches = [rows[:30], rows[30:45] + rows[50:60], rows[45:50] + rows[60:90], rows[90:]]  # some come late
    got = run_chats(spark, tmp_path, batches, lateness="30 minutes")
    whole = {r[:3]: r for r in (tuple(map(str, r)) for r in all_questions(spark.createDataFrame(rows, TURNS)).collect())}
    assert sorted(r[:3] for r in got) == sorted(whole)
    # a question that was answered before a late turn came had no way to know it
    late = {str(r[1]) for r in rows[50:60]}
    assert all(whole[r[:3]] == r for r in got if r[1] not in late) and sum(r[1] not in late for r in got) > 20


def test_idle_chats_are_dropped_and_too_late_turns_too(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    batches = [[("a", at(0), "user", "one")], [("b", at(500), "user", "other")], [("b", at(501), "user", "more")], [("a", at(502), "user", "two"), ("a", at(3), "user", "too late")]]
    got = run_chats(spark, tmp_path, batches, lateness="1 minute", idle_ms=60_000)
    assert [r[2] for r in got] == ["one", "other", "more", "two"] and got[-1][3] == "[]"


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "v"), "chunk_id", buckets=8)
    with pytest.raises(ValueError):
        store.read()
    store.upsert(spark.range(5000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.array(F.col("id").cast("double")).alias("embedding")))
    files = {(b, v) for b, v in store._versions().items()}
    touched = store.upsert(spark.createDataFrame([("c7", [-1.0]), ("new", [2.0])], "chunk_id string, embedding array<double>"))
    after = {(b, v) for b, v in store._versions().items()}
    assert 1 <= len(touched) <= 2 and {b for b, _ in files ^ after} == set(touched)
    table = {r["chunk_id"]: list(r["embedding"]) for r in store.read().collect()}
    assert len(table) == 5001 and table["c7"] == [-1.0] and table["new"] == [2.0] and table["c8"] == [8.0]
    with pytest.raises(ValueError, match="3 rows have 2 keys"):
        store.upsert(spark.createDataFrame([("x", [1.0]), ("x", [2.0]), ("y", [1.0])], "chunk_id string, embedding array<double>"))
    twice = spark.createDataFrame([("x", [1.0], 1), ("x", [2.0], 2)], "chunk_id string, embedding array<double>, n int")
    store.upsert(twice, order="n")
    assert [list(r["embedding"]) for r in store.read().where("chunk_id = 'x'").collect()] == [[2.0]]
    assert len(store.delete(spark.createDataFrame([("x",), ("absent",), (None,)], "chunk_id string"))) <= 2
    assert store.read().count() == 5001 and store.vacuum() and store.vacuum() == [] and store.read().count() == 5001


def test_scroll_equals_the_table(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "v"), "chunk_id", buckets=3)
    store.upsert(spark.range(3700).select(F.col("id").alias("chunk_id"), F.lit("t").alias("text"), F.array(F.lit(0.5)).alias("embedding")))
    seen, cursor, pages = [], None, 0
    while True:
        rows, cursor = store.scroll(cursor, 1000, ["chunk_id", "text"])
        seen += [r["chunk_id"] for r in rows]
        pages += 1
        assert all(set(r.asDict()) == {"chunk_id", "text"} for r in rows)
        if cursor is None:
            break
    assert pages == 4 and sorted(seen) == list(range(3700))
    # a cursor that was kept goes on after an upsert of other rows
    rows, cursor = store.scroll(None, 1000)
    store.upsert(spark.createDataFrame([(10_000, "n", [1.0])], "chunk_id long, text string, embedding array<double>"))
    rest, _ = store.scroll(cursor, 5000)
    assert not {r["chunk_id"] for r in rows} & {r["chunk_id"] for r in rest} and len(rows) + len(rest) >= 3700


def test_every_stage_has_a_time_and_rows(spark):
    chunks = spark.createDataFrame([(f"k{i}", i, 0, "", f"f{i}", 1, t) for i, t in enumerate(["alpha beta", "beta gamma", "delta alpha", "other words"])], "chunk_id string, document_id long, chunk_index int, folder string, filename string, page_num int, text string")
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0), F.col("document_id").cast("double")).alias("embedding"))
    asked = spark.createDataFrame([(1, 0, "alpha", [1.0, 0.0])], "query_id int, variant int, text string, vector array<double>")
    r = Retrieval(chunks, vectors, asked)
    said = r.generation(lambda: lambda messages: {"answer": "a", "model": "m"})
    assert said.count() == 1 and r.sources.count() == r.n_rows["sources"] > 0
    rows = {x["stage"]: x for x in r.timings().collect()}
    assert {"postings", "lexical_hits", "vector_hits", "fused", "expanded", "candidates", "gated", "reranked", "sources", "generation", "total"} <= set(rows)
    assert all(x["elapsed_ms"] >= 0 for x in rows.values()) and rows["gated"]["n_rows"] == 1 and rows["total"]["elapsed_ms"] == sum(x["elapsed_ms"] for s, x in rows.items() if s != "total")


def test_questions_of_many_bytes_are_dealt_to_many_tasks(spark, monkeypatch):
    from sedgewren.streaming import chats

    monkeypatch.setattr(chats, "SHARE", 1 << 14)
    rows = [(f"c{i % 50}", datetime.datetime(2024, 1, 1, 0, i // 50), "user", "word " * 100) for i in range(1000)]
    out = all_questions(spark.createDataFrame(rows, TURNS))
    assert out.select(F.spark_partition_id().alias("p"), "chat_id").groupBy("p").count().count() > 15
    assert out.count() == 1000


def test_rectangles_shuffle_pages_as_rows(spark):
    from sedgewren.plans.catalogue import QUERIES

    plan = QUERIES["highlight_rects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "posexplode" not in below and "x0" not in below  # words and boxes are made above the join
