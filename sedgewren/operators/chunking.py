"""Sentence-aligned overlapping chunks as an ordered fold over sentences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, OVERLAP, LEAST = 512, 50, 100
#: Chunks that a task hands on at once.
HANDED = 10_000


def sentences(text: str) -> list[str]:
    """What functions.text.sentences() gives for a text; white space is the same as str.split()'s there."""
    text = " ".join(text.split())
    for end in ".!?":
        text = text.replace(f"{end} ", f"{end}\n")
    return [s for s in text.split("\n") if s]


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of one page. Blanks between sentences do not count; a sentence is never cut; the tail of a chunk starts the next."""
    out: list[str] = []
    if text is None or len(text) < least:
        return out
    parts, n = [], 0
    for s in sentences(text):
        if parts and n + len(s) > size:
            whole = " ".join(parts).strip(" ")
            if len(whole) >= least:
                out.append(whole)
            tail = whole[-overlap:] if overlap > 0 else ""
            parts, n = [tail], len(tail)
        parts.append(s)
        n += len(s)
    whole = " ".join(parts).strip(" ")
    return [*out, whole] if len(whole) >= least else out


def chunk_pages(pages: DataFrame, **sizes: int) -> DataFrame:
    """chunk_id, text, page_num, chunk_index, char_count, has_ocr, document_id, filename, folder.

    ``pages`` has document_id, page_num, text, and optionally has_ocr, filename and folder. Indices run through a document's pages.
    """
    given = {c for c in pages.columns}
    extra = [(F.col(c) if c in given else F.lit(d)).alias(c) for c, d in (("has_ocr", False), ("filename", ""), ("folder", ""))]
    pages = pages.select("document_id", "page_num", *extra, "text")
    given = pages.columns[:-1]

    def run(batches):
        for batch in batches:
            at, pos, texts = [], [], []

            def rows():
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(given))), pa.array(pos, pa.int32()), pa.array(texts, pa.string())], names=[*given, "pos", "text"])

            for i, text in enumerate(batch.column(len(given)).cast(pa.binary())):
                value = text.as_py()
                cut = chunk_text(None if value is None else value.decode("utf-8", "replace"), **sizes)
                at += [i] * len(cut)
                pos += range(len(cut))
                texts += cut
                if len(texts) >= HANDED:
                    yield rows()
                    at, pos, texts = [], [], []
            if texts:
                yield rows()

    cut = pages.mapInArrow(run, T.StructType([*pages.schema.fields[:-1], T.StructField("pos", T.IntegerType()), pages.schema.fields[-1]]))
    order = Window.partitionBy("document_id").orderBy("page_num", "pos")
    numbered = cut.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))
    chunk_id = F.concat(F.col("document_id").cast("string"), F.lit("_p"), F.col("page_num").cast("string"), F.lit("_c"), F.col("chunk_index").cast("string"))
    return numbered.select(chunk_id.alias("chunk_id"), "text", "page_num", "chunk_index", F.length("text").alias("char_count"), "has_ocr", "document_id", "filename", F.coalesce("folder", F.lit("")).alias("folder"))
