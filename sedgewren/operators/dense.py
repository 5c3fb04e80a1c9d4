"""Exact cosine search of query vectors against a table of vectors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 9


#: Bytes of queries that are sent to all vectors; more are dealt into blocks of so many bytes.
SENT = 32 << 20
#: Vectors that are multiplied at once, and scores that a task hands on at once.
BLOCK, HANDED = 2048, 200_000


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def search(vectors: DataFrame, queries: DataFrame, pool: int, key: str = "vec_id", folder: str | None = None, document: str | None = None) -> DataFrame:
    """query_id, <key>, score, rank. ``queries`` has query_id, vector and, with ``folder`` or ``document`` (names of columns of
    ``vectors``), the folder or document to search in; null or empty is no filter.

    Filtered queries meet their vectors in an equi-join; the others meet every vector: queries of up to ``SENT`` bytes are sent
    to the vectors, which are multiplied with them batch by batch, more meet them block by block in a join on the block's number. Zero
    vectors have no direction and take no part. Only what may be among the pool's best of a query leaves a task before the ranks are dealt out.
    """
    filters = [(n, c) for n, c in (("folder", folder), ("document", document)) if c]
    normed = lambda rows, v, n: rows.withColumn(n, F.sqrt(_dot(F.col(v), F.col(v)))).where(F.col(n) > 0)
    rows = normed(vectors.select(key, F.col("embedding").alias("v"), *(F.col(c).cast("string").alias(f"_{n}") for n, c in filters)), "v", "vn")
    asked = normed(queries.select("query_id", F.col("vector").alias("q"), *(F.nullif(F.col(n).cast("string"), F.lit("")).alias(f"_{n}") for n, _ in filters)), "q", "qn")
    scored = None
    for used in itertools.chain.from_iterable(itertools.combinations([f"_{n}" for n, _ in filters], k) for k in range(len(filters), -1, -1)):
        some = asked
        for n, _ in filters:
            some = some.where(F.col(f"_{n}").isNotNull() if f"_{n}" in used else F.col(f"_{n}").isNull())
        some = some.drop(*(f"_{n}" for n, _ in filters if f"_{n}" not in used))
        found = _cosines(rows.join(some, list(used)), key) if used else _every_pair(rows.select(key, "v", "vn"), some, key, pool)
        scored = found if scored is None else scored.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def _cosines(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.select("query_id", key, F.round(_dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn")), DIGITS).alias("score"))


def _every_pair(rows: DataFrame, asked: DataFrame, key: str, pool: int) -> DataFrame:
    """Scores of each query's best vectors: of each block of vectors the pool's at most, and none below the pool's last of those that the task saw before."""
    spark = rows.sparkSession
    size = asked.agg(F.coalesce(F.sum(8 * F.size("q") + 64), F.lit(0))).first()[0]
    if size > SENT:
        blocks = -(-size // SENT)
        asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        dealt = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return _cosines(dealt.join(asked, "_block"), key)
    held = asked.collect()  # SENT bytes at most
    shared = spark.sparkContext.broadcast(([np.array(r["q"], np.float64) for r in held], np.array([r["qn"] for r in held])))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, norms = shared.value
        if not wanted:
            return
        top = np.full((len(wanted), pool), -np.inf)  # the best scores that the task has seen
        for batch in batches:
            batch = batch.take(pc.array_sort_indices(batch.column(key), null_placement="at_start"))  # equal scores are in the order of the key
            sizes = np.diff(np.asarray(batch.column("v").offsets))
            got, n = [], 0
            for d in np.unique(sizes):  # one length, as a rule; queries meet the vectors of their own
                some, mine = np.flatnonzero(sizes == d), np.array([i for i, q in enumerate(wanted) if len(q) == d])
                for begin in range(0, len(some) if len(mine) else 0, BLOCK):
                    at = some[begin : begin + BLOCK]
                    x = np.asarray(batch.column("v").take(pa.array(at)).flatten(), np.float64).reshape(len(at), d)
                    lengths = np.asarray(batch.column("vn"))[at]
                    for part in np.split(mine, range(256, len(mine), 256)):
                        who, which, scores = _best(np.stack([wanted[i] for i in part]) @ x.T / (norms[part][:, None] * lengths), top, part, pool)
                        got.append((part[who].astype(np.int32), at[which], scores))
                        n += len(who)
                        if n > HANDED:
                            yield _found(batch, key, got)
                            got, n = [], 0
            if n:
                yield _found(batch, key, got)

    found = rows.mapInArrow(run, f"_q int, `{key}` {kind}, score double")
    names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(held)], T.StructType([T.StructField("_q", T.IntegerType()), asked.schema["query_id"]]))
    return found.join(F.broadcast(names), "_q").select("query_id", key, "score")


def _best(scores: np.ndarray, top: np.ndarray, part: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of scores (a row for each query of ``part``) that may be among the queries' best; ``top`` learns of them.

    Of equal scores at the end of the pool the first columns stay. Scores that are no numbers are none.
    """
    scores = np.round(scores, DIGITS) + 0.0  # no negative zeros
    scores[np.isnan(scores)] = -np.inf
    better = np.partition(np.concatenate([top[part], scores], axis=1), -pool, axis=1)[:, -pool:]
    top[part] = better
    who, which = np.nonzero((scores >= better[:, :1]) & (scores > -np.inf))
    many = np.flatnonzero(np.bincount(who, minlength=len(part)) > pool)
    if len(many):
        keep = ~np.isin(who, many)
        first = [np.sort(np.argsort(-scores[i], kind="stable")[:pool]) for i in many]
        who, which = np.concatenate([who[keep], np.repeat(many, pool)]), np.concatenate([which[keep], *first])
    return who, which, scores[who, which]


def _found(batch: pa.RecordBatch, key: str, got: list) -> pa.RecordBatch:
    who, which, scores = (np.concatenate(x) for x in zip(*got))
    return pa.RecordBatch.from_arrays([pa.array(who), batch.column(key).take(pa.array(which)), pa.array(scores)], names=["_q", key, "score"])
