"""Two-pass shuffle into shards: law, slots, order and defined cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewren.llm import queries, sharding

DATA = "/root/testdata/sf0.001"


def check(rows, n_shards):
    """Counts at most one apart, and gapless slots."""
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(n_shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n_shards))


def test_query_against_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op11_sharding(spark, DATA).collect()
    check(rows, 16)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert sorted(map(tuple, queries.op11_sharding(spark, DATA).collect())) == sorted(map(tuple, rows))


def test_order_is_random_and_of_the_seed(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    place = lambda seed: np.array([r["doc_id"] for r in sharding.shuffled(docs, 4, seed, bucket_bytes=2048).orderBy("shard", "slot").collect()])
    a, b = place(1), place(2)
    assert sorted(a.tolist()) == list(range(4000)) and (a != b).mean() > 0.99
    assert abs(np.corrcoef(a, np.arange(4000))[0, 1]) < 0.06 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.06
    assert (place(1) == a).all()


def test_fisher_yates_gives_every_order_alike():
    rng = np.random.default_rng(3)
    seen = {}
    for _ in range(12_000):
        order = tuple(sharding.fisher_yates(4, rng))
        seen[order] = seen.get(order, 0) + 1
    assert len(seen) == 24 and min(seen.values()) > 380 and max(seen.values()) < 620
    assert sharding.fisher_yates(0, rng) == [] and sharding.fisher_yates(1, rng) == [0]


def test_defined_cases(spark):
    rows = [(None, None, "x")] * 5 + [(None, "", "x")] + [(1, "copy", "y")] * 40 + [(2, "word " * 50_000, "z"), (3, "é\x00漢", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("_bucket", F.lit(1)).withColumn("row", F.lit("mine")).withColumn("n", F.lit(2)).withColumn("_copy", F.lit("own"))
    out = sharding.shuffled(docs.repartition(5), 4)
    assert out.columns == ["doc_id", "text", "_bucket", "row", "n", "_copy", "law", "shard", "slot"]
    got = out.collect()
    check(got, 4)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted((key(r) for r in got)) == sorted((str(a), str(b)) for a, b, _ in rows)
    assert len({(r["shard"], r["slot"]) for r in got if r["doc_id"] == 1}) == 40
    assert sharding.shuffled(docs.limit(0)).count() == 0
    few = sharding.shuffled(docs.limit(2), 16).collect()
    check(few, 16)


def test_a_hot_id_is_scattered(spark):
    docs = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shuffled(docs, 8)
    check(out.collect(), 8)
    hot = {r["shard"]: r["count"] for r in out.where("doc_id is null").groupBy("shard").count().collect()}
    assert len(hot) == 8 and max(hot.values()) < 2 * 1000 / 8


def test_files_are_in_the_order_of_slots(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    mixed = sharding.shuffled(docs, 4, bucket_bytes=300)
    sharding.write(mixed, str(tmp_path / "out"))
    import pyarrow.parquet as pq

    for folder in sorted((tmp_path / "out").glob("shard=*")):
        runs = [pq.read_table(f)["slot"].to_pylist() for f in sorted(folder.glob("*.parquet"))]
        assert all(r == sorted(r) for r in runs)
        assert sorted(sum(runs, [])) == list(range(sum(map(len, runs))))


def test_begins_are_sums_of_the_buckets_before(spark):
    n = np.random.default_rng(5).integers(1, 9, 3000)
    counts = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n) if i % 7], "_bucket long, n long")
    got = {r["_bucket"]: r["_begin"] for r in sharding.begins(counts).collect()}
    upto, want = 0, {}
    for i, x in enumerate(n):
        if i % 7:
            want[i] = upto
            upto += int(x)
    assert got == want


def test_tasks_get_equal_shares_and_hand_them_on_in_pieces(spark):
    docs = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 40).alias("text"))
    mixed = sharding.shuffled(docs, 4, bucket_bytes=40_000)  # about 100 buckets, two to a task
    held = mixed.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(held) > 45 and max(r["count"] for r in held) < 1.4 * 20_000 / len(held)
    check(mixed.collect(), 4)


@pytest.mark.parametrize("rows,shards", [(1, 16), (15, 16), (16, 16), (17, 16), (1000, 7)])
def test_cuts_are_equal(spark, rows, shards):
    check(sharding.shuffled(spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), shards).collect(), shards)
