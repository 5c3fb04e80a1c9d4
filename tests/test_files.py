"""Files with broken ones among them, outcomes of batches, and a stream whose work follows the batch."""

import pytest
from pyspark.sql import functions as F

from sedgewren.operators import catalog
from sedgewren.operators.chunking import chunk_pages
from sedgewren.sources.documents import page_stats, pdf_pages
from sedgewren.sources.files import NOT_PDF, PageReader, page_source
from sedgewren.streaming.ingest import STATE_STORE, ingest, page_stream

LONG = "A sentence that is long enough to be a chunk, as it has more than a hundred characters in all of its many words. "


def parser():
    def parse(data):
        text = data.decode()
        if text.startswith("BROKEN"):
            raise ValueError("damaged file")

        def page(x):
            if x == "BAD":
                raise OSError("damaged page")
            return x

        return [lambda x=x: page(x) for x in text.split("|")], {"author": "Ann"} if text.startswith("By") else {}

    return parse


def ocr():
    def look(data, number):
        if number == 2:
            raise RuntimeError("no engine")
        return f"seen on page {number}"

    return look


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    files = {"a.pdf": "By " + LONG, "b.pdf": "BROKEN", "c.PDF": f"{LONG}|x|", "d.txt": LONG, "deep/a.pdf": f"{LONG}|BAD|{LONG}", "e.pdf": "By " + LONG, "f.pdf": "short", "g.pdf": "\xff"}
    for name, text in files.items():
        (tmp_path / "in" / name).write_bytes(text.encode("latin-1"))
    return str(tmp_path / "in")


@pytest.mark.parametrize("how", ["source", "ranges", "spark"])
def test_broken_files_and_pages_are_rows(spark, folder, how):
    if how == "spark":
        pages = pdf_pages(spark, folder, parser, ocr)
    else:
        spark.dataSource.register(page_source(parser, ocr))
        pages = spark.read.format("pages").option("rangeBytes", 100 if how == "ranges" else 1 << 20).load(folder)
    rows = {(r["path"].split("/in/")[1], r["page_num"]): r for r in pages.collect()}
    state = {k: (r["status"], r["error"]) for k, r in rows.items()}
    assert state["b.pdf", None] == ("error", "damaged file") and state["d.txt", None] == ("error", NOT_PDF) and state["deep/a.pdf", 2] == ("error", "damaged page")
    assert state["g.pdf", None][0] == "error" and state["deep/a.pdf", 3] == ("ok", None) and len(rows) == 12
    texts = {k: (r["text"], r["has_ocr"], r["char_count"]) for k, r in rows.items() if r["status"] == "ok"}
    # a page that OCR can't read is empty and marked, as one that it reads is marked
    assert texts["c.PDF", 2] == ("", True, 0) and texts["c.PDF", 3] == ("seen on page 3", True, 14) and texts["f.pdf", 1][0] == "seen on page 1"
    assert texts["c.PDF", 1] == (LONG.strip(), False, len(LONG.strip()))
    assert (rows["a.pdf", 1]["author"], rows["c.PDF", 1]["author"], rows["c.PDF", 1]["title"], rows["c.PDF", 1]["page_count"]) == ("Ann", "Unknown", "c", 3)
    got = page_stats(pages.where("status = 'ok'")).first()
    assert tuple(got) == (8, 3, 1)


def test_outcomes_of_a_folder(spark, folder):
    pages = pdf_pages(spark, folder, parser, ocr)
    chunks = chunk_pages(catalog.sound_pages(pages).withColumn("folder", F.lit("")))
    found = catalog.file_outcomes(pages, chunks.select(F.col("document_id").alias("hash")))
    got = {r["path"].split("/in/")[1]: (r["status"], r["error"], r["pages"], r["chunks_created"]) for r in found.collect()}
    assert got.pop("g.pdf")[0] == "error"
    assert got == {
        "a.pdf": ("indexed", None, 1, 1), "b.pdf": ("error", "damaged file", None, 0), "c.PDF": ("indexed", None, 3, 1), "d.txt": ("error", NOT_PDF, None, 0),
        "deep/a.pdf": ("error", "damaged page", 3, 0), "e.pdf": ("skipped", None, 1, 0), "f.pdf": ("error", catalog.NO_TEXT, 1, 0),
    }
    assert tuple(catalog.batch_summary(found).first()) == (2, 1, 5, 8)
    known = found.where("status = 'indexed'").select("hash")
    again = catalog.batch_summary(catalog.file_outcomes(pages, chunks.select(F.col("document_id").alias("hash")), known)).first()
    assert tuple(again) == (0, 3, 5, 8)


def test_partitions_divide_large_files_and_pack_small_ones(tmp_path):
    for i in range(10):
        (tmp_path / f"s{i}.pdf").write_bytes(b"x" * 30)
    (tmp_path / "large.pdf").write_bytes(b"y" * 250)
    parts = [p.files for p in PageReader(str(tmp_path), 100, parser, None).partitions()]
    assert [f for p in parts for f in p if f[0].endswith("large.pdf")] == [(str(tmp_path / "large.pdf"), i, 3) for i in range(3)]
    small = [p for p in parts if not p[0][0].endswith("large.pdf")]
    assert sorted(len(p) for p in small) == [1, 3, 3, 3]


def test_status_of_a_hot_hash(spark):
    rows = [(i, b"same") for i in range(50)] + [(100, b"new"), (101, b"old"), (102, b"new")]
    files = spark.createDataFrame(rows, "ord long, content binary")
    known = spark.createDataFrame([("x",)], "hash string").unionByName(files.where("ord = 101").select(F.md5("content").alias("hash")))
    got = {r["ord"]: r["status"] for r in catalog.ingest_status(files, known).collect()}
    assert sorted(k for k, v in got.items() if v == "indexed") == [0, 100] and len(got) == 53
    plan = catalog.ingest_status(files).select("ord", "status")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def docs(spark, path, rows):
    spark.createDataFrame([(i, t, f"f{i}", "") for i, t in rows], "document_id long, text string, filename string, folder string").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **options):
    q = ingest(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), **options)
    q.awaitTermination()
    return q


def bytes_read(spark, first: int) -> int:
    """Bytes that stages from number ``first`` on have read from files."""
    from py4j.java_gateway import java_import  # noqa: F401

    store, n = spark.sparkContext._jsc.sc().statusStore(), 0
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    for i in range(stages.size()):
        s = stages.apply(i)
        n += s.inputBytes() if s.stageId() >= first else 0
    return n


def test_a_batch_costs_as_much_however_many_came_before(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    read = []
    for n in range(6):
        docs(spark, str(tmp_path / "in"), [(100 * n + i, f"{n} {i} {LONG}") for i in range(40)] + [(100 * n + 99, f"0 0 {LONG}")])
        marker = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
        run(spark, tmp_path)
        read.append(bytes_read(spark, marker))
    assert {k: spark.conf.get(k, None) for k in STATE_STORE} == before
    assert read[5] < 1.3 * read[1] and read[1] > 0
    ids = [r["document_id"] for r in spark.read.parquet(str(tmp_path / "out")).select("document_id").distinct().collect()]
    assert sorted(ids) == sorted(100 * n + i for n in range(6) for i in range(40))


def test_forgotten_texts_come_again(spark, tmp_path):
    docs(spark, str(tmp_path / "in"), [(1, LONG), (2, LONG + "more"), (3, None)])
    hashes = "hash string"
    spark.createDataFrame([], hashes).write.parquet(str(tmp_path / "gone"))
    gone = lambda: spark.readStream.schema(hashes).parquet(str(tmp_path / "gone"))
    taken = lambda: sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("document_id").distinct().collect())
    run(spark, tmp_path, forget=gone())
    assert taken() == [1, 2]
    docs(spark, str(tmp_path / "in"), [(4, LONG), (5, LONG + "more")])
    spark.createDataFrame([(LONG,)], "t string").select(F.md5("t").alias("hash")).write.mode("append").parquet(str(tmp_path / "gone"))
    run(spark, tmp_path, forget=gone())
    assert taken() == [1, 2, 4]


def test_a_failed_batch_is_taken_again(spark, tmp_path):
    docs(spark, str(tmp_path / "in"), [(1, LONG)])

    def fails(rows, number):
        raise OSError("index is away")

    with pytest.raises(Exception, match="index is away"):
        run(spark, tmp_path, then=fails)
    seen = []
    run(spark, tmp_path, then=lambda rows, number: seen.append((number, rows.count())))
    assert seen == [(0, 1)]
