"""Incremental ingestion: files as a stream, known content dropped, chunks appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedgewren.operators.catalog import content_hash
from sedgewren.operators.chunking import chunk_pages

SCHEMA = "document_id long, text string, filename string, folder string"


def page_stream(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Parquet files of documents that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


#: The state store that keeps keys on disk and writes the changes of a batch only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def started(spark: SparkSession, writer, settings: dict[str, str] = STATE_STORE) -> StreamingQuery:
    """Start a stream under settings that it takes with it; the session's own stay as they were."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal texts in an Arrow batch only that of the smallest document_id goes on to the shuffle."""
    for batch in batches:
        least: dict = {}
        for i, (h, d, gone) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hash", "document_id", "forget")))):
            if (h, gone) not in least or (d is not None and (least[h, gone][0] is None or d < least[h, gone][0])):
                least[h, gone] = (d, i)
        yield batch.take(pa.array(sorted(i for _, i in least.values()), pa.int64()))


def _first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = None
    for part in parts:
        if part["forget"].any() and state.exists:
            state.remove()
        part = part[~part["forget"]]
        if len(part):
            row = part.sort_values("document_id").iloc[:1]
            best = row if best is None or row["document_id"].iloc[0] < best["document_id"].iloc[0] else best
    if best is not None and not state.exists:
        state.update((True,))
        yield best.drop(columns="forget")


def new_texts(stream: DataFrame, forget: DataFrame | None = None) -> DataFrame:
    """Rows of a stream (document_id and text among its columns) whose text never came before, with hash.

    What was seen is state keyed by the text's hash, so a batch looks up its own hashes only, however many there were before. Of equal
    texts in one batch the smallest document_id stays. ``forget`` is a stream of hashes whose texts were deleted and may come again;
    those of a batch are forgotten before its texts are looked at.
    """
    rows = stream.withColumn("hash", content_hash(F.col("text"))).withColumn("forget", F.lit(False))
    if forget is not None:
        rows = rows.unionByName(forget.select("hash", F.lit(True).alias("forget")), allowMissingColumns=True)
    thin = rows.where("hash is not null").mapInArrow(_thinned, rows.schema)
    out = T.StructType([f for f in rows.schema if f.name != "forget"])
    return thin.groupBy("hash").applyInPandasWithState(_first, out, "taken boolean", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True, then: Callable[[DataFrame, int], None] | None = None, forget: DataFrame | None = None) -> StreamingQuery:
    """Chunk documents whose text is new and append the chunks to ``out``; each micro-batch has its own folder.

    Late or repeated files add nothing (see new_texts()). A batch that is run again after a failure starts from the state before it and
    overwrites its own folder, so every document is written once. ``then`` is called with the chunks that were written and the
    batch's number, as for segments.SegmentedIndex.append() and models.embed().
    """
    spark = stream.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        pages = batch.select("document_id", F.lit(1).alias("page_num"), "text", "filename", "folder")
        chunk_pages(pages).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if then:
            then(spark.read.parquet(f"{out}/batch={number}"), number)

    writer = new_texts(stream, forget).writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint)
    return started(spark, writer.trigger(availableNow=True) if available_now else writer)


def messages(stream: DataFrame) -> DataFrame:
    """Questions of a chat channel's message stream: empty ones and commands are skipped."""
    return stream.where("text is not null and trim(text) <> '' and not startswith(trim(text), '/')").select("chat_id", F.trim("text").alias("question"), F.lit(3).alias("top_k"), F.lit("telegram").alias("channel"))
