"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewren.sources.stage import freed, small, staged

__all__ = ["Cache", "PIECE", "WORD_PATTERN", "freed", "in_small_batches", "small", "staged", "table", "with_columns"]

#: Words are runs of anything but ASCII white space; bytes.split() cuts at exactly these six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch, about, that a worker handles at once.
PIECE = 4 << 20
#: Rows of an Arrow batch of whole texts, and the setting that holds them.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """Have the session hand whole texts on in Arrow batches of ``BATCH_ROWS`` rows, unless it was told another number itself.

    The session's default of 10,000 rows makes batches of tens of megabytes, which JVM and worker hold several times.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "10000") == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def with_columns(df: DataFrame, f: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Append columns that ``f`` computes from Arrow batches; columns of the same names give way to the new ones."""
    new = {x.name.lower() for x in fields}
    kept = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in new]) if any(c.lower() in new for c in df.columns) else df
    names = [*kept.columns, *(x.name for x in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):  # in pieces, so that what is made of a batch is not held at once
                part = batch.slice(i, step)
                yield pa.RecordBatch.from_arrays([*part.columns, *f(part)], names=names)

    return in_small_batches(kept).mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


class Cache(dict):
    """Values by key, computed when they are missing; of ``most`` / 2 to ``most`` entries the longest unused ones go first.

    Keys longer than ``longest`` are computed each time, so the cache's bytes are bounded too.
    """

    def __init__(self, compute: Callable, most: int, longest: int = 40):
        self.compute, self.half, self.longest, self.old = compute, most // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def lacking(self, keys: set) -> list:
        """Of many keys those to compute, with which the caller updates the cache; the others are in it afterwards, but for long keys."""
        missing = keys.difference(self)
        if self and len(self) + len(missing) > self.half:
            self.old, missing = dict(self), keys
            self.clear()
        again = missing.intersection(self.old)
        self.update(zip(again, map(self.old.__getitem__, again)))
        return [k for k in missing.difference(again) if len(k) <= self.longest]
