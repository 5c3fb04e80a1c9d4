"""A coarse vector index: cells around trained centres, stored by cell, so that a search reads the files of few cells.

Centres come from MLlib's k-means over at most ``SAMPLE`` unit vectors, chosen by a hash of their keys.  Every vector is stored in the
folder of its nearest centre, and each cell's widest angle is kept beside the centres.  A search names the cells it asks for in a
filter on the partition column, and queries meet their cells' vectors in an equi-join; scores are exact cosines of what is found.

``probes`` asks for that many nearest cells of each query.  Without it a search is exact: the best score that a vector of a cell
can have follows from the angle to its centre and the cell's widest angle, so after the nearest cells only those are read which can
still hold a better vector than the pool's last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewren.operators.dense import DIGITS, SENT, _dot
from sedgewren.sources.stage import located, small, staged

#: Vectors that the centres are fitted to, at most; vectors for each cell, about; and cells at most.
SAMPLE, CELL, CELLS = 20_000, 400, 4096
#: Cells that an exact search reads before it knows a bound.
FIRST = 2
#: What angles may be off by.
SLACK = 1e-6


def _unit(v: Column) -> Column:
    norm = F.sqrt(_dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


class Cells:
    """The index in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", cells: int | None = None, seed: int = 3) -> Cells:
        """Train on ``vectors`` (the key and embedding among their columns) and store them all. Vectors that are null or zero have no
        direction and are left out."""
        self = cls(vectors.sparkSession, path)
        usable = vectors.withColumn("_unit", _unit(F.col("embedding"))).where("_unit is not null")
        n = usable.count()
        sample = staged(usable.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(array_to_vector("_unit").alias("features")), "cell-sample")
        k = max(2, min(cells or math.ceil(n / CELL), CELLS))
        model = KMeans(k=k, maxIter=10, seed=seed, distanceMeasure="euclidean", initMode="random").fit(sample) if n > k else None
        if model is None:
            raise ValueError("too few vectors for cells; search them with dense.search()")
        model.write().overwrite().save(f"{self.path}/centres")
        self.add(vectors)
        return self

    def add(self, vectors: DataFrame) -> None:
        """Store more vectors in the cells there are; their angles are looked at again, the centres are not."""
        model = KMeansModel.load(f"{self.path}/centres")
        rows = vectors.withColumn("_unit", _unit(F.col("embedding"))).where("_unit is not null").withColumn("_f", array_to_vector("_unit"))
        placed = model.setFeaturesCol("_f").setPredictionCol("cell").transform(rows).drop("_f", "_unit")
        placed.repartition("cell", F.pmod(F.xxhash64(*vectors.columns[:1]), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        centres = self._centres(model)
        near = self.vectors().withColumn("_c", F.get(F.lit(centres.tolist()), F.col("cell")))
        cosine = _dot(_unit(F.col("embedding")), F.col("_c"))
        near.groupBy("cell").agg(F.max(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))).alias("angle")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/angles")

    @staticmethod
    def _centres(model: KMeansModel) -> np.ndarray:
        """Directions of the centres: ``CELLS`` rows at most."""
        c = np.array(model.clusterCenters())
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        return c / np.where(norm > 0, norm, 1.0)

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def nearest_cells(self, queries: DataFrame) -> DataFrame:
        """query_id, q, qn (its length), scope columns, cell, place, best: every cell of each query by the angle to its centre, with the best
        cosine that one of its vectors can have."""
        centres = self._centres(KMeansModel.load(f"{self.path}/centres"))
        angles = {r["cell"]: r["angle"] for r in self.spark.read.parquet(f"{self.path}/angles").collect()}  # CELLS rows at most
        cells = np.array(sorted(angles))
        shared = self.spark.sparkContext.broadcast((cells, centres[cells], np.array([angles[c] for c in cells])))
        scope = [f for f in queries.schema if f.name not in ("vector",)]
        rows = queries.select(*(f.name for f in scope), F.transform("vector", lambda x: x.cast("double")).alias("q"), F.sqrt(_dot(F.col("vector"), F.col("vector"))).alias("qn")).where("qn > 0")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, directions, wide = shared.value
            for batch in batches:
                for at in range(0, len(batch), 256):
                    some = batch.iloc[at : at + 256]
                    away = np.arccos(np.clip(np.stack(some["q"]) @ directions.T / some["qn"].to_numpy()[:, None], -1, 1))
                    order = np.argsort(away, axis=1, kind="stable")
                    best = np.cos(np.maximum(0.0, np.take_along_axis(away - wide, order, 1) - SLACK))
                    out = some.loc[some.index.repeat(len(ids))].reset_index(drop=True)
                    yield out.assign(cell=ids[order].ravel().astype("int32"), place=np.tile(np.arange(1, len(ids) + 1, dtype="int32"), len(some)), best=best.ravel())

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInPandas(run, f"{schema}, cell int, place int, best double")

    def search(self, queries: DataFrame, pool: int, key: str = "vec_id", probes: int | None = None, folder: str | None = None, document: str | None = None) -> DataFrame:
        """query_id, <key>, score, rank, as dense.search() gives them; of ``probes`` cells of each query, or of all that matter.

        ``queries``: query_id, vector and, with ``folder`` or ``document`` (names of columns of the stored rows), the folder or document to
        search in; null or empty is no filter.
        """
        filters = [(n, c) for n, c in (("folder", folder), ("document", document)) if c]
        asked = queries.select("query_id", "vector", *(F.nullif(F.col(n).cast("string"), F.lit("")).alias(f"_{n}") for n, _ in filters))
        near = self.nearest_cells(asked)
        if probes:
            return self._ranked(self._scored(staged(near.where(F.col("place") <= probes), "probes"), key, filters, pool), key, pool)
        near = staged(near, "cells")
        first = staged(self._scored(near.where(F.col("place") <= FIRST), key, filters, pool), "first-cells")
        last = self._ranked(first, key, pool).where(F.col("rank") == pool).select("query_id", F.col("score").alias("last"))
        # scores are rounded, so a vector that is behind by less than the last digit can still come first by its key
        rest = near.where(F.col("place") > FIRST).join(small(staged(last, "bounds")), "query_id", "left")
        rest = staged(rest.where(F.col("last").isNull() | (F.col("best") >= F.col("last") - 2 * 10.0**-DIGITS)).drop("last"), "more-cells")
        return self._ranked(first.unionByName(self._scored(rest, key, filters, pool)), key, pool)

    def _scored(self, asked: DataFrame, key: str, filters: list[tuple[str, str]], pool: int | None = None) -> DataFrame:
        """Scores of the vectors in the asked cells; ``asked`` names (query, cell) and is staged.

        With ``pool``, and without filters, only each query's best of each batch of vectors are given: the pool's, and all that equal the
        last of them. Queries of up to ``SENT`` bytes are sent to the cells for that.
        """
        cells = [r[0] for r in asked.select("cell").distinct().collect()]  # CELLS at most
        rows = self.vectors().where(F.col("cell").isin(cells)).select(key, "cell", "embedding", *dict.fromkeys(c for _, c in filters))
        if pool and not filters:
            held = asked.groupBy("query_id").agg(F.first("q").alias("q"), F.first("qn").alias("qn"), F.collect_list("cell").alias("cells"))  # CELLS at most
            held = staged(held.withColumn("_q", F.monotonically_increasing_id()), "cell-queries")
            if held.agg(F.coalesce(F.sum(8 * F.size("q") + 8 * F.size("cells") + 64), F.lit(0))).first()[0] <= SENT:
                return self._best(rows, held, key, pool)
        met = rows.withColumn("n", F.sqrt(_dot(F.col("embedding"), F.col("embedding")))).join(small(asked.select("query_id", "q", "qn", "cell", *(f"_{n}" for n, _ in filters))), "cell")
        for n, c in filters:
            met = met.where(F.col(f"_{n}").isNull() | (F.col(f"_{n}") == F.col(c).cast("string")))
        return met.select("query_id", key, F.round(_dot(F.col("q"), F.col("embedding")) / (F.col("qn") * F.col("n")), DIGITS).alias("score"))

    def _best(self, rows: DataFrame, held: DataFrame, key: str, pool: int) -> DataFrame:
        """query_id, <key>, score of the best of each batch; ``held`` has _q, query_id, q, qn and cells."""
        found = held.select("_q", "q", "qn", "cells").collect()  # SENT bytes at most
        of: dict[int, list[int]] = {}
        for i, r in enumerate(found):
            for c in r["cells"]:
                of.setdefault(c, []).append(i)
        shared = self.spark.sparkContext.broadcast(([r["_q"] for r in found], [np.array(r["q"], np.float64) for r in found], np.array([r["qn"] for r in found]), of))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, wanted, norms, of = shared.value
            numbers = np.array(numbers, np.int64)
            for batch in batches:
                keys, cells, v = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
                sizes = np.diff(np.asarray(v.offsets))
                for c, d in {(int(c), int(d)) for c, d in zip(cells, sizes)}:
                    some, mine = np.flatnonzero((cells == c) & (sizes == d)), [i for i in of.get(c, []) if len(wanted[i]) == d]
                    if not mine:
                        continue
                    x = np.asarray(v.take(pa.array(some)).flatten(), np.float64).reshape(len(some), d)
                    lengths = np.sqrt((x * x).sum(axis=1))
                    for at in range(0, len(mine), 256):
                        part = np.array(mine[at : at + 256])
                        scores = np.round(np.stack([wanted[i] for i in part]) @ x.T / (norms[part][:, None] * lengths), DIGITS) + 0.0  # no negative zeros
                        least = np.partition(scores, -pool, axis=1)[:, -pool] if scores.shape[1] > pool else np.full(len(part), -np.inf)
                        who, which = np.nonzero(scores >= least[:, None])
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[part[who]]), keys.take(pa.array(some[which])), pa.array(scores[who, which])], names=["_q", key, "score"])

        kind = rows.schema[key].dataType.simpleString()
        best = rows.mapInArrow(run, f"_q long, `{key}` {kind}, score double")
        return best.join(small(held.select("_q", "query_id")), "_q").select("query_id", key, "score")

    @staticmethod
    def _ranked(scored: DataFrame, key: str, pool: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).select("query_id", key, "score", "rank")

    def drop(self) -> None:
        where, system = located(self.spark, self.path)
        system.delete(where, True)
