"""Hard negatives by one-dimensional distance keys.

Scores are inner products of integer vectors.  A vector x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared
length, and an anchor q gets 0 there: then the distance between them is sqrt(|q|^2 + M - 2 q.x), so the highest scores are the nearest
rows.  ``PIVOTS`` points are fitted by k-means to at most ``SAMPLE`` rows chosen by a hash of their ids; every row is stored under
its nearest pivot, sorted by (pivot, distance to it), in blocks of about ``BLOCK`` neighbouring keys.

A row at distance r from a pivot that is d away from the anchor is at least |d - r| away from the anchor.  So with a radius R only the
keys in [d - R, d + R] of every pivot are scanned.  An anchor's radius starts small and grows in rounds; each round scans the rings of
keys that the one before left out.  Once k rows are found within the radius, no row outside it can do better, which certifies them; if they
lie beyond, the next radius is the distance of the k-th.  Negatives are searched alike, from the distance of the highest score that
is allowed outwards, for all of an anchor's positives at once.

Anchors are sent to the blocks whose keys they ask for, in slices of ``SLICE`` anchors, and a block meets each slice of them in
one task, which gives the best few rows of each; no pair is written.  What the driver gets is the sample, the blocks' edges (some tens of bytes
for ``BLOCK`` rows) and the number of open anchors.

Rows of the same vector and label have the same score for every anchor, so the ``keep`` smallest ids of them stand for all: no anchor
can ask for more.  Scores are exact: in doubles while M is below 2^53, in Python's integers beyond.

Defined cases: rows with a null id, label or vector or with a null component take no part; of rows that share an id the one of
the least label, then vector, counts; a row is not its own positive; ties go to the smaller id; with fewer rows than asked for all are
given; shorter vectors are filled up with zeros, empty ones are zero; without positives, or with negative scores of them, an anchor has no
negatives; components beyond a long's range are cut to it, and so are scores; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import freed, small, staged

PIVOTS = 64
SAMPLE = 4096
BLOCK = 65_536
SLICE = 16_384
#: Anchors whose products with a run of rows are formed at once.
TOGETHER = 32
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where a component is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~F.coalesce(odd, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _unique(rows: DataFrame) -> DataFrame:
    """One row for each id."""
    often = staged(rows.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if often.isEmpty():
        return rows
    often = small(often)
    least = rows.join(often, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return rows.join(often, "id", "left_anti").unionByName(least)


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """Lists of longs as rows of length ``d``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten(), np.int64)
    if len(flat) == len(sizes) * d:
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def _stored(vectors, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<i8").reshape(len(vectors), d)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))[:, None]], axis=1)


def fit_pivots(x: np.ndarray, n: int = PIVOTS, rounds: int = 10, seed: int = 12) -> np.ndarray:
    """Centres of a k-means over ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0))


class Index:
    """Rows sorted by (pivot, distance) in blocks, as a staged table, and what is known of the blocks."""

    def __init__(self, rows: DataFrame, keep: int):
        """``rows``: id, label, v (array of longs), one for each id; ``keep`` rows of equal vectors and labels stay."""
        spark = rows.sparkSession
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        self.d, self.most = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # a bounded sample
        x = _matrix(pa.array([r["v"] for r in sample], pa.list_(pa.int64())), self.d)
        self.sample, self.labels = x, np.array([r["label"] for r in sample], object)
        self.pivots = fit_pivots(augmented(x, self.most)) if sample else np.zeros((0, self.d + 1))
        #: what distances may be off by, as they are formed in doubles
        self.slack = 1e-6 * (1 + float(np.sqrt(self.most)))
        keyed = staged(rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")).mapInArrow(partial(_keyed, spark.sparkContext.broadcast((self.pivots, self.most)), self.d), f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, h1 long, h2 long, pivot int, dist double, v binary"), "keys")
        same = ["h1", "h2", "label"]
        large = staged(keyed.groupBy(*same).count().where(F.col("count") > keep).select(*same), "copies")
        if not large.isEmpty():
            large = small(large)
            first = Window.partitionBy(*same).orderBy("id")  # the limit is taken in each task before the shuffle
            few = keyed.join(large, same, "left_semi").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep).drop("_n")
            keyed = keyed.join(large, same, "left_anti").unionByName(few.select(*keyed.columns))
        self.rows, self.blocks = self._sorted(keyed.drop("h1", "h2"))

    def _sorted(self, keyed: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
        sizes = keyed.groupBy("pivot").count().agg(F.max("count")).first()[0] or 0
        rings = max(1, -(-sizes // BLOCK))
        edges = keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / rings for i in range(1, rings)], 10_000).alias("edges") if rings > 1 else F.array().cast("array<double>").alias("edges"))
        ring = F.size(F.filter("edges", lambda e: e < F.col("dist")))
        placed = keyed.join(F.broadcast(edges), "pivot").withColumn("ring", ring).drop("edges")  # PIVOTS rows
        stored = staged(placed.repartition("pivot", "ring").sortWithinPartitions("pivot", "dist"), "sorted-keys")
        found = stored.groupBy("pivot", "ring").agg(F.min("dist"), F.max("dist"), F.count("*")).collect()  # one row for BLOCK rows
        found.sort(key=lambda r: r[:2])
        columns = list(zip(*found)) or [()] * 5
        blocks = {n: np.array(c, t) for n, c, t in zip(("pivot", "ring", "least", "most", "parts"), columns, (int, int, float, float, int))}
        # keys that many rows share can't be cut by rings
        blocks["parts"] = -(-blocks["parts"] // (2 * BLOCK))
        cut = [(int(p), int(r), int(n)) for p, r, n in zip(blocks["pivot"], blocks["ring"], blocks["parts"]) if n > 1]
        if cut:
            table = stored.sparkSession.createDataFrame(cut, "pivot int, ring int, parts int")
            stored = stored.join(F.broadcast(table), ["pivot", "ring"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        else:
            stored = stored.withColumn("part", F.lit(0))
        return stored, blocks

    def first_radius(self, k: int) -> float:
        """The median distance to the k-th row of the same label, within the sample."""
        if len(self.sample) < 2:
            return 1.0
        x = augmented(self.sample, self.most)
        ask = x[:256].copy()
        ask[:, -1] = 0.0
        far = _distances(ask, x)
        far[self.labels[:256, None] != self.labels[None, :]] = np.inf
        kth = np.sort(far, axis=1)[:, min(k, far.shape[1] - 1)]
        return float(np.median(kth[np.isfinite(kth)])) if np.isfinite(kth).any() else float(np.sqrt(self.most)) + 1.0


def _keyed(shared, d, batches):
    pivots, most = shared.value
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("v"), d)
            far = _distances(augmented(x, most), pivots)
            near = far.argmin(1)
            packed = pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())
            named = {c: batch.column(c) for c in ("id", "label", "h1", "h2")}
            yield pa.RecordBatch.from_pydict(named | {"pivot": pa.array(near, pa.int32()), "dist": pa.array(far[np.arange(len(x)), near]), "v": packed})


def _asked(shared, d, batches):
    """An anchor's row for each block with keys that it hasn't seen and that its radius reaches."""
    pivots, blocks, slack = shared.value
    for batch in batches:
        if not batch.num_rows:
            continue
        q = np.concatenate([_stored(batch.column("v"), d).astype(np.float64), np.zeros((batch.num_rows, 1))], axis=1)
        away = _distances(q, pivots)[:, blocks["pivot"]]
        r0, r1, inner = (np.asarray(batch.column(c))[:, None] for c in ("r0", "r1", "inner"))
        nearest = np.maximum(0.0, np.maximum(blocks["least"] - away, away - blocks["most"]))
        farthest = np.maximum(np.abs(away - blocks["least"]), np.abs(away - blocks["most"]))
        who, block = np.nonzero((nearest <= r1 + 2 * slack) & (farthest >= r0 - 2 * slack) & (away + blocks["most"] >= inner - 2 * slack))
        taken = batch.take(pa.array(who))
        new = {"away": pa.array(away[who, block]), "pivot": pa.array(blocks["pivot"][block], pa.int32()), "ring": pa.array(blocks["ring"][block], pa.int32()), "parts": pa.array(blocks["parts"][block], pa.int32())}
        yield pa.RecordBatch.from_pydict({n: taken.column(n) for n in batch.schema.names} | new)


def _products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Scores of rows and anchors, as longs."""
    if exact:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    return np.clip(x.astype(object) @ q.astype(object).T, LEAST, MOST).astype(np.int64)


def _scan(d, k, same, exact, slack, kinds, held: pa.Table, asking: pa.Table) -> pa.Table:
    """The best ``k`` rows of a block for each target of each anchor, among keys within its radius that it hasn't seen."""
    out: list[list] = [[], [], [], []]
    if held.num_rows and asking.num_rows:
        held, asking = held.sort_by("dist"), asking.sort_by("away")
        x, dist, ids, labels = _stored(held.column("v"), d), np.asarray(held.column("dist")), np.array(held.column("id").to_pylist()), np.array(held.column("label").to_pylist(), object)
        q = _stored(asking.column("v"), d)
        away, r0, r1, inner = (np.asarray(asking.column(c)) for c in ("away", "r0", "r1", "inner"))
        ask_ids, ask_labels = asking.column("id").to_pylist(), asking.column("label").to_pylist()
        targets = [list(zip(*t)) for t in zip(*(asking.column(c).to_pylist() for c in ("nos", "los", "his")))]
        begin = np.searchsorted(dist, np.maximum(away - r1 - slack, inner - away - slack), "left")
        end = np.searchsorted(dist, away + r1 + slack, "right")
        # the keys that rounds before have seen
        seen_from = np.where(r0 < 0, end, np.searchsorted(dist, away - r0 - slack, "left"))
        seen_to = np.where(r0 < 0, end, np.searchsorted(dist, away + r0 + slack, "right"))
        for a in range(0, len(q), TOGETHER):
            some = slice(a, a + TOGETHER)
            low, high = int(begin[some].min()), int(end[some].max())
            if high <= low:
                continue
            scores = _products(x[low:high], q[some], exact)
            for i, s in enumerate(scores.T, a):
                place = np.concatenate((np.arange(begin[i], max(begin[i], min(end[i], seen_from[i]))), np.arange(max(begin[i], seen_to[i]), max(begin[i], seen_to[i], end[i]))))
                place = place[((labels[place] == ask_labels[i]) == same) & (ids[place] != ask_ids[i])]
                near = s[place - low]
                for no, least, most in targets[i]:
                    fits = np.flatnonzero((near >= least) & (near <= most))
                    if len(fits) > k:
                        fits = fits[near[fits] >= np.partition(near[fits], -k)[-k]]
                    best = fits[np.lexsort((ids[place[fits]], -near[fits]))][:k]
                    for o, v in zip(out, ([ask_ids[i]] * len(best), [no] * len(best), ids[place[best]].tolist(), near[best].tolist())):
                        o.extend(v)
    return pa.table({n: pa.array(v, t) for n, v, t in zip(("anchor", "no", "id", "score"), out, kinds)})


def _far(score) -> Column:
    """The distance at which a row of this score lies from the anchor."""
    return F.sqrt(F.greatest(F.col("reach") - 2 * score.cast("double"), F.lit(0.0)))


def nearest(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor, no, id, score, rank: the ``k`` best rows for each target of each anchor, certified.

    ``anchors``: id, label, v (as stored), nos, los, his (numbers of the targets, and the least and the highest score of each), r1 (the
    first radius) and inner (the distance below which no row is asked for). Rows have the anchor's label, or another if not ``same``.
    """
    spark, d = anchors.sparkSession, index.d
    shared = spark.sparkContext.broadcast((index.pivots, index.blocks, index.slack))
    id_kind = anchors.schema["id"].dataType
    result = f"anchor {id_kind.simpleString()}, no int, id {id_kind.simpleString()}, score long"
    kinds = [pa.string() if id_kind.simpleString() == "string" else pa.int64() if id_kind.simpleString() == "bigint" else pa.int32(), pa.int32(), None, pa.int64()]
    kinds[2] = kinds[0]
    square = F.aggregate("whole", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    open_ = staged(anchors.withColumn("reach", square + F.lit(float(index.most))).drop("whole").withColumn("r0", F.lit(-1.0)).withColumn("far", 2 * F.sqrt("reach") + 1), "anchors")
    slices = max(1, -(-open_.count() // SLICE))
    found = None
    order = Window.partitionBy("anchor", "no").orderBy(F.desc("score"), "id")
    while not open_.isEmpty():
        fields = [*(f"{f.name} {f.dataType.simpleString()}" for f in open_.schema), "away double", "pivot int", "ring int", "parts int"]
        asked = open_.mapInArrow(partial(_asked, shared, d), ", ".join(fields)).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = index.rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))) if slices > 1 else index.rows.withColumn("slice", F.lit(0))
        key = ["pivot", "ring", "part", "slice"]
        got = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(partial(_scan, d, k, same, index.most < 1 << 53, index.slack, kinds), result)
        every = got if found is None else got.unionByName(found.drop("rank"))
        now = staged(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        stats = now.groupBy(F.col("anchor").alias("id"), "no").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        each = open_.select("id", "reach", "r1", "far", F.explode(F.arrays_zip("nos", "los")).alias("t")).select("id", "reach", "r1", "far", F.col("t.nos").alias("no"), F.col("t.los").alias("lo"))
        each = each.join(stats, ["id", "no"], "left")
        full, bounded = F.coalesce(F.col("n") >= k, F.lit(False)), F.col("lo") > LEAST
        want = F.when(full, _far(F.col("worst"))).when(bounded, _far(F.col("lo"))).otherwise(2 * F.col("r1"))
        each = each.withColumn("want", F.least(want, F.col("far"))).where((F.col("r1") < F.col("far")) & (F.col("want") > F.col("r1")))
        grown = each.groupBy("id").agg((F.max("want") * (1 + 1e-9) + index.slack).alias("next"))
        still = staged(open_.join(grown, "id").withColumn("r0", F.col("r1")).withColumn("r1", F.col("next")).drop("next"), "anchors")
        freed(open_, *([found] if found is not None else []))
        open_, found = still, now
    return found if found is not None else spark.createDataFrame([], result + ", rank int")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id, label, v (array of longs, see whole_components()); ``is_anchor`` is a condition over id. Negatives of an anchor and one of
    its positives are rows of other labels whose score is at least ``low`` and at most ``high`` per cent of the positive's.
    """
    rows = _unique(rows.where("id is not null and label is not null and v is not null and not exists(v, x -> x is null)").select("id", "label", "v"))
    index = Index(rows, max(positives + 1, negatives))
    pad = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(index.d) - F.size("v"))).alias("whole")
    anchors = staged(rows.where(is_anchor).select("id", "label", pad), "anchor-rows")
    anchors = anchors.mapInArrow(partial(_packed, index.d), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema), "v binary"]))
    one = lambda x, kind: F.array(F.lit(x).cast(kind))
    asking = anchors.select("*", one(0, "int").alias("nos"), one(LEAST, "long").alias("los"), one(MOST, "long").alias("his"), F.lit(index.first_radius(positives)).alias("r1"), F.lit(0.0).alias("inner"))
    liked = nearest(index, asking, positives, True)
    liked = liked.select(F.col("anchor").alias("anchor_id"), F.col("rank").alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    wide = F.col("positive_score").cast("decimal(20,0)")
    bounds = liked.where("positive_score >= 0").select("anchor_id", "no", F.ceil(wide * low / 100).cast("long").alias("lo"), F.floor(wide * high / 100).cast("long").alias("hi")).where("lo <= hi")
    bounds = bounds.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("no", "lo", "hi"))).alias("t"))  # ``positives`` of an anchor at most
    asking = anchors.join(bounds, "id").select("id", "label", "whole", "v", F.col("t.no").alias("nos"), F.col("t.lo").alias("los"), F.col("t.hi").alias("his"))
    asking = asking.withColumn("reach", F.aggregate("whole", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) + F.lit(float(index.most)))
    begin, last = _far(F.array_min("his")), _far(F.array_min("los"))
    asking = asking.withColumn("r1", begin + 0.15 * (last - begin)).withColumn("inner", _far(F.array_max("his"))).drop("reach")
    disliked = nearest(index, asking, negatives, False)
    disliked = disliked.select(F.col("anchor").alias("anchor_id"), "no", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return liked.join(disliked, ["anchor_id", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _packed(d, batches):
    for batch in batches:
        x = _matrix(batch.column("whole"), d)
        packed = pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*batch.schema.names, "v"])
