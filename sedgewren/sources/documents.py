"""Sources of pages: parquet tables in the shapes of this library, and PDF files behind a pluggable parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.functions.text import SPACE, stripped
from sedgewren.sources.files import OCR_LEAST, SCHEMA, page_rows
from sedgewren.sources.stage import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on whole texts."""
    return spread(documents(spark, sf_dir), f"{sf_dir}/documents.parquet", "doc_id")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: one page each, the source as folder."""
    return spread_documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_num"), "text", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.coalesce("source", F.lit("")).alias("folder"), needs_ocr("text").alias("has_ocr"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, a turn as a page."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_num"), "text", F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("filename"), F.lit("").alias("folder"))


def needs_ocr(text: str):
    """A page of under 50 characters goes to OCR, and is marked so whether or not OCR finds anything."""
    head = F.regexp_replace(F.left(text, F.lit(10 * OCR_LEAST)), SPACE + "+", "")  # a long text is not looked through to its end
    return F.when(F.length(head) >= OCR_LEAST, F.lit(False)).otherwise(F.length(stripped(F.col(text))) < OCR_LEAST)


def page_stats(pages: DataFrame, *by: str) -> DataFrame:
    return pages.groupBy(*by).agg(F.count("*").alias("n_pages"), F.count_if("has_ocr").alias("n_ocr"), F.count_if(stripped(F.col("text")) == "").alias("n_empty"))


def pdf_pages(spark: SparkSession, path: str, parser: Callable[[], Callable], ocr: Callable[[], Callable[[bytes, int], str]] | None = None) -> DataFrame:
    """Rows of files.SCHEMA of the files below a folder, by Spark's own reader of whole files, for stores that only Spark reads.

    ``parser`` and ``ocr`` are as for files.page_source(), which divides large files by their pages; here a file is one row of at most
    2 GB. Broken files and pages are rows of status "error" here, too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse, look = parser(), ocr() if ocr else None
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(list(page_rows(path_, content, parse, look)), columns=names, dtype=object)

    return files.mapInPandas(run, SCHEMA)
