"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates.  In round i every shingle is hashed to a bin and a value, and each bin keeps the least
(round, value); rounds go on until every bin is full, and from round ``BINS`` on round ``BINS + b`` hashes to bin b alone,
so all coordinates are full after at most twice ``BINS`` rounds.  Long documents need one round.  Coordinates are cut into
bands; the band width is the largest at which a pair at the threshold is missed with a chance below ``MISS``.

Documents of equal shingle sets form a class, and only classes are compared.  Classes that share a band are joined to
candidate groups.  A group of up to ``BLOCK`` classes is verified in one task: all intersections of its full sets come
from one sparse or dense product, and only the resulting labels leave the task.  In larger groups every class is first
verified against the least class of each of its bands; what is then still in different components is verified in pairs
of blocks of different components, which lose no pair that shares a band.  No pairs are listed, no group is gathered, nothing is capped.

Defined cases: null texts and texts without words have the empty set, are linked with nothing and stay; repeated rows are
documents of equal sets; a null doc_id joins its class, and the least of the other ids stands for it; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.llm.common import PIECE, freed, in_small_batches, small, staged
from sedgewren.llm.graph import components
from sedgewren.llm.shingles import STEP, scrambled, shingle_set

BINS = 128
MISS = 1e-6
BLOCK = 256
#: Groups of at most so many classes are verified as a whole; larger ones band by band.
WHOLE_GROUP = 64 * BLOCK
#: Shingles sketched at once.
CHUNK = 400_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 48) - 1)
_48, _16 = np.uint64(48), np.uint64(16)


def band_shape(percent: int, bins: int = BINS) -> tuple[int, int]:
    """(bands, rows of a band) for a threshold in per cent."""
    s = percent / 100
    rows = max((r for r in range(1, bins + 1) if (1 - s**r) ** (bins // r) <= MISS), default=1)
    return bins // rows, rows


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Sketch of each non-empty set of 64-bit hashes."""
    out = np.full(len(sets) * bins, EMPTY, np.uint64)
    if not sets:
        return out.reshape(0, bins)
    values = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])
    for i in range(2 * bins):
        h = scrambled(values + np.uint64((int(STEP) * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = ((h >> _48) * np.uint64(bins) >> _16).astype(np.int64) if i < bins else np.int64(i - bins)
        np.minimum.at(out, doc * bins + at, np.uint64(i << 48) | (h & _LOW))
        todo = (out.reshape(-1, bins) == EMPTY).any(axis=1)
        if not todo.any():
            break
        keep = todo[doc]
        values, doc = values[keep], doc[keep]
    return out.reshape(-1, bins)


def _bands(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands)).copy()
    for r in range(rows):
        key = scrambled((key + STEP) ^ sketch[:, r : bands * rows : rows])
    return key.view(np.int64)


def _sketched(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, n_shingles, key (128-bit digest of the set; null if empty), bands."""
    bands, rows = band_shape(percent)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids, sets):
            full = [s for s in sets if len(s)]
            keys = iter(_bands(sketches(full), bands, rows).tolist())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key", "bands"],
            )

        for batch in batches:
            ids, sets, n = [], [], 0
            id_type = batch.column(0).type
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                ids.append(i.as_py())
                sets.append(shingle_set(text.as_py(), width))
                n += len(sets[-1])
                if n >= CHUNK:
                    yield emit(ids, sets)
                    ids, sets, n = [], [], 0
            if ids:
                yield emit(ids, sets)

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, key binary, bands array<long>")


def _sets(docs: DataFrame, classes: DataFrame, width: int, repeated: bool) -> DataFrame:
    """(cid, set) of classes (cid, key, low); ``repeated`` says that some of their least ids occur in several rows."""

    def run(batches):
        for batch in batches:
            step = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                sets = [shingle_set(x.as_py(), width).tobytes() for x in batch.column(0).slice(i, step).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.large_binary() if sum(map(len, sets)) > 1 << 30 else pa.binary())], names=["key", "set"])

    lows = small(staged(classes.select("low"), "lows"))
    texts = docs.select("doc_id", "text").join(lows, F.col("doc_id").eqNullSafe(F.col("low")), "left_semi")
    sets = texts.select("text").mapInArrow(run, "key binary, set binary")
    sets = sets.dropDuplicates(["key"]) if repeated else sets
    return sets.join(small(staged(classes.select("cid", "key"), "keys")), "key").select("cid", "set")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets."""
    m = len(sets)
    values, ids = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, ids = values[order], ids[order]
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    n = np.diff(np.r_[start, len(values)])
    keep = np.repeat(n > 1, n)  # a value of one set alone is in no intersection
    ids, n = ids[keep], n[n > 1]
    group = np.repeat(np.arange(len(n)), n)
    out = np.zeros((m, m), np.int64)
    if 20.0 * float((n.astype(float) ** 2).sum()) < float(m) * m * len(n):
        flat = np.zeros(m * m, np.int64)
        for d in range(1, int(n.max(initial=1))):
            same = group[d:] == group[:-d]
            flat += np.bincount(ids[:-d][same] * m + ids[d:][same], minlength=m * m)
        out = flat.reshape(m, m)
        return out + out.T
    for a in range(0, len(n), 8192):
        lo, hi = np.searchsorted(group, (a, a + 8192))
        x = np.zeros((m, min(8192, len(n) - a)), np.float32)
        x[ids[lo:hi], group[lo:hi] - a] = 1
        out += (x @ x.T).astype(np.int64)
    np.fill_diagonal(out, 0)
    return out


def _block_links(sets: list[np.ndarray], parts: list, percent: int, apart: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join different parts, no more than needed to join them, and the part of each set then."""
    index = {p: i for i, p in enumerate(dict.fromkeys(parts))}
    up = list(range(len(index)))
    own = [index[p] for p in parts]

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
        found = np.array([[0, 0 + (100 * both >= percent * (len(a) + len(b) - both))], [0, 0]])
    else:
        both = intersections(sets)
        found = np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1)
    if apart is not None:
        found &= apart
    links = []
    for i, j in zip(*np.nonzero(found)):
        a, b = root(own[i]), root(own[j])
        if a != b:
            up[max(a, b)] = min(a, b)
            links.append((int(i), int(j)))
    return links, [root(x) for x in own]


def _by_block(rows: DataFrame, f, names_out: tuple[str, str]) -> DataFrame:
    """Apply ``f(list of rows)`` to the rows of each block; rows come sorted, so a task holds one block at a time."""
    names = rows.columns
    rows = rows.repartition("block").sortWithinPartitions("block")

    def run(batches):
        block, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(names.index(c)) for c in names)):
                row = dict(zip(names, (x.as_py() for x in row)))
                if row["block"] != block:
                    out += f(held) if held else []
                    block, held = row["block"], []
                row["set"] = np.frombuffer(row["set"], np.uint64)
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=list(names_out))
        if held and (out := f(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=list(names_out))

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names_out))


def _across(placed: DataFrame) -> DataFrame:
    """block, cid, part, side, inside: the pairs of blocks in which classes of different parts meet, group by group.

    ``placed`` has g, cid, part. A part of at least half a block lies in blocks of its own, which meet those of other parts alone;
    smaller parts share blocks, whole, and those meet all blocks, themselves included. Groups of one part give no row.
    """
    sizes = placed.groupBy("g", "part").agg(F.count("*").alias("m")).withColumn("own", F.col("m") >= BLOCK // 2)
    large = F.when(F.col("own"), F.ceil(F.col("m") / BLOCK)).otherwise(0)
    groups = sizes.groupBy("g").agg(F.count("*").alias("parts"), F.ceil(F.sum(F.when(F.col("own"), 0).otherwise(F.col("m"))) / BLOCK).alias("shared"), F.sum(large).alias("larges")).where("parts > 1")
    groups = small(staged(groups.select("g", "shared", (F.col("shared") + F.col("larges")).alias("total")), "open-groups"))
    # blocks are numbered from 0: the shared ones, then those of each large part, of which a group has few against its classes
    ahead = F.sum("blocks").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = sizes.where("own").select("g", "part", F.ceil(F.col("m") / BLOCK).alias("blocks")).withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    ranges = small(staged(ranges, "large-parts"))
    rows = placed.join(groups, "g").join(ranges, ["g", "part"], "left").withColumn("lo", F.col("shared") + F.col("ahead")).withColumn("hi", F.col("lo") + F.col("blocks"))
    own = F.when(F.col("lo").isNull(), F.pmod(F.xxhash64("part"), F.greatest("shared", F.lit(1)))).otherwise(F.col("lo") + F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))))
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    none, total = F.lit(0).cast("long"), F.col("total").cast("long")
    others = F.when(F.col("lo").isNull(), span(none, total)).otherwise(F.concat(span(none, F.col("lo")), span(F.col("hi"), total)))
    rows = rows.select("g", "cid", "part", own.alias("own"), F.explode(others).alias("other"))
    return rows.select(F.struct("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("block"), "cid", "part", (F.col("own") < F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("inside"))


def _labels(candidates: DataFrame, groups: DataFrame, sets_of, percent: int) -> DataFrame:
    """(cid, label) of the candidate classes that exact verification joined; ``sets_of`` gives the sets of classes."""

    def whole(held):
        links, parts = _block_links([r["set"] for r in held], [r["cid"] for r in held], percent)
        least: dict[int, int] = {}
        for r, p in zip(held, parts):
            least[p] = min(least.get(p, r["cid"]), r["cid"])
        return [(r["cid"], least[p]) for r, p in zip(held, parts)] if links else []

    def star(held):
        pivot = next((r["set"] for r in held if r["cid"] == r["pivot"]), None)
        if pivot is None:
            return []
        out = []
        for r in held:
            s = r["set"]
            if r["cid"] != r["pivot"] and 100 * min(len(s), len(pivot)) >= percent * max(len(s), len(pivot)):
                both = len(np.intersect1d(s, pivot, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(pivot) - both):
                    out.append((r["pivot"], r["cid"]))
        return out

    def rest(held):
        inside = held[0]["inside"]
        side = np.array([r["side"] for r in held])
        apart = None if inside else side[:, None] != side[None, :]
        links, _ = _block_links([r["set"] for r in held], [r["part"] for r in held], percent, apart)
        return [(held[i]["cid"], held[j]["cid"]) for i, j in links]

    few = groups.where(F.col("n") <= BLOCK).select(F.col("label").alias("block"), F.col("node").alias("cid"))
    labels = staged(_by_block(sets_of(few.select("cid")).join(few, "cid").select("block", "cid", "set"), whole, ("cid", "label")), "labels")
    many = groups.where(F.col("n") > BLOCK)
    if many.isEmpty():
        return labels
    many = staged(many, "large-groups")
    sets = staged(sets_of(many.select(F.col("node").alias("cid"))), "sets")
    pairs = staged(candidates.join(many.select(F.col("node").alias("cid"), F.col("label").alias("gid"), "n"), "cid").select("band", "cid", "pivot", "gid", "n"), "large-bands")
    beams = pairs.where(F.col("cid") != F.col("pivot")).select("pivot", "cid").distinct()
    counts = beams.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    salted = beams.join(counts, "pivot").withColumn("salt", F.pmod(F.xxhash64("cid"), "salts"))
    centres = counts.select("pivot", F.col("pivot").alias("cid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    blocks = salted.select("pivot", "cid", "salt").unionByName(centres).join(sets, "cid").select(F.struct("pivot", "salt").alias("block"), "pivot", "cid", "set")
    links = staged(_by_block(blocks, star, ("a", "b")), "beams")
    part = staged(components(links), "parts")
    placed = pairs.join(part.select(F.col("node").alias("cid"), F.col("label").alias("part")), "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    placed = placed.select(F.when(F.col("n") <= WHOLE_GROUP, F.struct(F.lit(0).alias("kind"), F.col("gid").alias("id"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("band").alias("id"))).alias("g"), "cid", "part").distinct()
    placed = staged(placed, "placed")
    open_ = _across(placed).join(sets, "cid").select("block", "cid", "part", "set", "side", "inside")
    found = staged(_by_block(open_, rest, ("a", "b")), "rest")
    joined = staged(components(links.unionByName(found)).select(F.col("node").alias("cid"), "label"), "large-labels")
    freed(sets, pairs, links, found, part, placed)
    return labels.unionByName(joined)


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (least id that links reach), kept: one row for each document.

    Two documents are linked if 100 * size of the intersection >= percent * size of the union of their shingle sets.
    """
    rows = staged(_sketched(docs, percent, width), "sketches")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.first("bands").alias("bands"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = classes.select("cid", F.explode("bands").alias("band"))
    shared = small(staged(members.groupBy("band").agg(F.count("*").alias("n"), F.min("cid").alias("pivot")).where("n > 1").select("band", "pivot"), "shared"))
    candidates = staged(members.join(shared, "band").select("band", "cid", "pivot"), "candidates")
    nodes = staged(components(candidates.select(F.col("pivot").alias("a"), F.col("cid").alias("b"))), "nodes")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"))
    groups = staged(nodes.join(sizes, "label"), "groups")
    freed(nodes)
    in_groups = classes.select("cid", "key", "low").join(groups.select(F.col("node").alias("cid")), "cid", "left_semi")
    repeated = not rows.select("doc_id").join(in_groups.select(F.col("low").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").count().where("count > 1").isEmpty() or not rows.where("doc_id is null").isEmpty()
    sets_of = lambda some: _sets(docs, classes.select("cid", "key", "low").join(some, "cid", "left_semi"), width, repeated)
    labels = staged(_labels(candidates, groups, sets_of, percent), "labels")
    freed(candidates, groups)
    known = classes.select("cid", "key", "low").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = known.groupBy("label").agg(F.min("low").alias("component_id"))
    of_class = known.join(least, "label").select("key", "component_id")
    out = rows.select("doc_id", "n_shingles", "key").join(of_class, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
