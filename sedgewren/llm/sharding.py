"""Shards in random order by a two-pass external shuffle.

The first pass scatters rows uniformly into buckets that fit into a task's memory, by a seeded hash of their ids.  The second
brings each bucket into a fixed order and shuffles it by Fisher and Yates' method, with a generator seeded by seed and bucket.
Each task gets ``TASK`` buckets, by their number and not by its hash, and hands their rows on in small pieces.
The buckets one after the other are a random order of all rows; where a bucket begins follows from the numbers of rows of those
before it, summed within runs of ``RUN`` buckets first.  Shards are equal cuts of that order (law ``rows``: their numbers of rows
differ by one at most), and a row's slot is its place in its shard, so a shard is some whole buckets and parts of two, and
is written by several tasks in order.

Only the hash decides a row's bucket, so a row that is computed again after a loss goes where it went before.  Rows whose ids
are equal are numbered first, in the order of a staged table: the number of a row is that of the rows before it in its own part of
a file and in the parts before, so that neither a null id nor one that a third of all rows share puts them into one bucket or task.

Defined cases: a null text has no bytes; empty and very long texts are moved whole (a bucket is larger than ``BUCKET`` bytes only by
chance or where one text is); repeated rows and equal texts are rows of their own, each with a slot of its own; rows of a null id too;
fewer rows than shards leave shards empty; an empty table gives an empty table.  Other columns pass through, and columns that have
the names of the results are replaced.  With one seed, results are equal in each run if no two rows have the same id, and else up to which
of these rows comes where.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewren.llm.common import in_small_batches, small, staged

#: Bytes of text that a bucket holds, about.
BUCKET = 8 << 20
#: Buckets in a run, whose rows are summed by one task.
RUN = 1024
#: Buckets that a task brings into order, one after the other.
TASK = 2
#: Bytes of a piece of a bucket that is handed on, about.
PIECE = 1 << 20
LAW = "rows"


def text_bytes(text: str = "text") -> Column:
    """Bytes of a text in UTF-8, none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def repeated(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys that several rows have; None if there are none."""
    often = staged(rows.groupBy(key).count().where("count > 1").select(key), "repeated-keys")
    return None if often.isEmpty() else small(often)


def numbered(rows: DataFrame, key: str, often: DataFrame | None) -> DataFrame:
    """Append _copy: 0 for a row whose key is not in ``often`` (see repeated()), else numbers from 0 on within the key."""
    if often is None:
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    alone = rows.join(often, key, "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    # written first: the place of a row in its file then stays the same whenever a task runs again
    several = staged(rows.join(often, key, "left_semi"), "repeated-rows")
    several = staged(several.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "placed-rows")
    parts = several.groupBy(key, "_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_at")) - 1
    known = several.withColumn("_here", here).join(small(staged(parts.withColumn("_before", before).drop("n"), "parts")), [key, "_part"])
    return alone.unionByName(known.withColumn("_copy", (F.col("_here") + F.col("_before")).cast("long")).select(*rows.columns, "_copy"))


def begins(counts: DataFrame) -> DataFrame:
    """_bucket, _begin: the number of rows in all buckets before; ``counts`` has _bucket and n."""
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.withColumn("_run", F.floor(F.col("_bucket") / RUN))
    inside = runs.withColumn("_inside", upto(Window.partitionBy("_run").orderBy("_bucket")))
    totals = runs.groupBy("_run").agg(F.sum("n").alias("n"))  # one row for each RUN buckets
    totals = totals.withColumn("_outside", upto(Window.orderBy("_run"))).select("_run", "_outside")
    return inside.join(totals, "_run").select("_bucket", (F.col("_inside") + F.col("_outside")).cast("long").alias("_begin"))


def fisher_yates(n: int, rng: np.random.Generator) -> list[int]:
    """A random order of 0 to n - 1, each as likely as any other."""
    order = list(range(n))
    if n > 1:
        draws = rng.integers(0, np.arange(n, 1, -1))  # for the last place one of n, for the one before it one of n - 1, ...
        for i, j in zip(range(n - 1, 0, -1), draws.tolist()):
            order[i], order[j] = order[j], order[i]
    return order


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 7, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET) -> DataFrame:
    """All rows with law, shard and slot (long); see write() for files in that order."""
    new = {"law", "shard", "slot"}
    columns = [c for c in docs.columns if c.lower() not in new]
    rows, weight = docs.agg(F.count("*"), F.coalesce(F.sum(text_bytes(text) + 1), F.lit(0))).first()
    buckets = max(4 * shards, -(-weight // bucket_bytes))
    packed = docs.select(F.xxhash64(F.col(f"`{key}`")).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    scattered = F.pmod(F.xxhash64(F.lit(seed), "_key", "_copy"), F.lit(buckets)).alias("_bucket")
    keys = docs.select(F.xxhash64(F.col(f"`{key}`")).alias("_key"))
    often = repeated(keys, "_key")
    # a row's number within its key matters to its bucket alone, so the numbers of rows follow from the keys without any text
    counts = staged(numbered(keys, "_key", often).groupBy(scattered).agg(F.count("*").alias("n")), "bucket-rows")
    dealt = numbered(packed, "_key", often).select(scattered, F.xxhash64(F.lit(seed + 1), "_key", "_copy").alias("_order"), "_key", "_copy", "row")
    dealt = dealt.join(small(staged(begins(counts), "bucket-begins")), "_bucket").select("_bucket", "_begin", "_order", "_key", "_copy", "row")
    # by number, as a hash deals three times as many buckets to some tasks as to others
    dealt = dealt.repartitionById(-(-buckets // TASK), F.floor(F.col("_bucket") / TASK).cast("int")).sortWithinPartitions("_bucket", "_order", "_key", "_copy")
    fields = T.StructType([dealt.schema["row"], T.StructField("_place", T.LongType())])

    def mixed(held: list[pa.RecordBatch]):
        held = pa.Table.from_batches(held).combine_chunks()
        order = fisher_yates(held.num_rows, np.random.default_rng([seed, held.column("_bucket")[0].as_py()]))
        begin, step = held.column("_begin")[0].as_py(), max(1, held.num_rows * PIECE // max(1, held.nbytes))
        row = held.column("row").combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        for i in range(0, len(order), step):
            some = order[i : i + step]
            yield pa.RecordBatch.from_arrays([row.take(pa.array(some, pa.int64())), pa.array(np.arange(begin + i, begin + i + len(some)))], names=["row", "_place"])

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            of = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if held and of[a] != bucket:
                    yield from mixed(held)
                    held = []
                bucket = of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from mixed(held)

    out = in_small_batches(dealt).mapInArrow(run, fields)
    # doubles hold these quotients well enough for any number of rows below 2^48
    shard = (F.ceil((F.col("_place") + 1) * shards / F.lit(max(rows, 1))) - 1).cast("int")
    first = F.floor(shard.cast("long") * F.lit(rows) / F.lit(shards)).cast("long")
    return out.select("row.*", F.lit(LAW).alias("law"), shard.alias("shard"), (F.col("_place") - first).alias("slot"))


def write(mixed: DataFrame, path: str) -> None:
    """Write shuffled rows into one folder for each shard; the files of a shard, and the rows of each, are in the order of their slots."""
    mixed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
