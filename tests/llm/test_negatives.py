"""Hard negatives against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from sedgewren.llm import negatives, queries

DATA = "/root/testdata/sf0.001"


def brute(rows, is_anchor, positives=5, negatives_=3, low=50, high=95):
    """``rows``: (id, label, whole components), one for each id."""
    out = []
    for a, la, va in rows:
        if not is_anchor(a):
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v))  # noqa: E731, B023
        order = lambda found: sorted(found, key=lambda t: (-t[1], t[0]))
        good = order([(i, score(v)) for i, x, v in rows if x == la and i != a])[:positives]
        bad = order([(i, score(v)) for i, x, v in rows if x != la])
        for p, ps in good:
            fit = [(i, s) for i, s in bad if low * ps <= 100 * s <= high * ps][:negatives_]
            out += [(a, p, n, i, ps, s) for n, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def mined(spark, rows, every=5):
    df = spark.createDataFrame(rows, "id long, label int, v array<bigint>")
    return got(negatives.mine(df, F.col("id") % every == 0))


def test_query_equals_brute_force(spark):
    rows = []
    for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect():
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], label, [math.floor(256 * float(x)) for x in r["embedding"]]))
    want = brute(rows, lambda i: i % 50 == 0)
    assert len(want) > 20 and got(queries.op12_negatives(spark, DATA)) == want


def test_clusters_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (6, 8))
    rows = [(i, int(rng.integers(0, 4)), [int(x) for x in np.floor(centres[rng.integers(6)] + rng.normal(0, 15, 8))]) for i in range(600)]
    rows += [(600 + i, i % 3, rows[0][2]) for i in range(200)]  # a large group of copies of several labels
    rows += [(800 + i, 1, [int(x) for x in rng.integers(-2, 3, 8)]) for i in range(60)]  # many ties
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_small_blocks_and_slices_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [int(x) for x in rng.integers(-40, 41, 5)]) for i in range(400)] + [(400 + i, 0, [0, 0, 0, 0, 0]) for i in range(50)]
    want = brute(rows, lambda i: i % 5 == 0)
    for name, value in (("BLOCK", 16), ("SLICE", 20), ("PIVOTS", 3), ("TOGETHER", 4)):
        monkeypatch.setattr(negatives, name, value)
    # the functions' defaults were bound before
    monkeypatch.setattr(negatives.fit_pivots, "__defaults__", (3, 10, 12))
    assert mined(spark, rows) == want


def test_defined_cases(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [3, 4])]) == []  # no other row
    rows = [(0, 1, [10, 0]), (1, 1, [8, 1]), (2, 2, [6, 5]), (3, 2, [7]), (4, 3, []), (5, 1, [-9, 2]), (7, 4, [5, 0, 9])]
    padded = [(i, x, v + [0] * (3 - len(v))) for i, x, v in rows]
    assert mined(spark, rows) == brute(padded, lambda i: i % 5 == 0)
    odd = [(None, 1, [1, 1]), (8, None, [1, 1]), (9, 1, None), (10, 1, [1, None])]
    twice = [(3, 2, [7]), (3, 9, [100]), (1, 1, [8, 2])]  # of an id the least label, then vector, counts
    assert mined(spark, rows + odd + twice) == brute(padded, lambda i: i % 5 == 0)
    big = [(i, i % 2, [2 * 10**8 * (i + 1), 3 * 10**8]) for i in range(12)]  # products beyond the doubles' whole numbers
    assert mined(spark, big) == brute(big, lambda i: i % 5 == 0)
    huge = spark.createDataFrame([(i, i % 2, [9e300, -9e300]) for i in range(6)], "id long, label int, e array<double>")
    assert got(negatives.mine(huge.select("id", "label", negatives.whole_components(F.col("e")).alias("v")), F.col("id") % 5 == 0)) is not None


def test_components(spark):
    rows = [([0.5, -0.001],), ([float("nan"), 1.0],), ([float("inf")],), ([None],), (None,), ([],)]
    df = spark.createDataFrame(rows, "e array<float>").select(negatives.whole_components(F.col("e")).alias("v"))
    assert [r["v"] for r in df.collect()] == [[128, -1], None, None, None, None, []]


def test_far_rows_are_left_out(spark):
    """Keys prune: anchors of one cluster do not ask for the blocks of clusters far away."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [int(x) for x in (np.eye(8)[i % 8] * 5000 + rng.normal(0, 20, 8))]) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, label int, v array<bigint>")
    index = negatives.Index(df, 6)
    shared = type("B", (), {"value": (index.pivots, index.blocks, index.slack)})
    import pyarrow as pa

    x = np.array([r[2] for r in rows[:8]], "<i8")
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(8)), "v": pa.array([r.tobytes() for r in x], pa.binary()), "r0": [-1.0] * 8, "r1": [index.first_radius(5)] * 8, "inner": [0.0] * 8})
    (asked,) = negatives._asked(shared, index.d, [batch])
    assert 8 <= asked.num_rows < 0.5 * 8 * len(index.blocks["pivot"])
