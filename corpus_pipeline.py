"""A training-data pipeline over documents: toxicity, quality, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``, in their order and with any further columns, whatever
these are called.  Every stage gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm import bpe, mixing, neardup, quality, toxicity
from sedgewren.llm.common import freed, small, staged, table
from sedgewren.llm.queries import tokenizer_path

WEIGHTS = [5, 2, 1]


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row in ``row``: what a stage adds then clashes with no column of the documents."""
    return docs.select(*names, F.struct(*_columns(docs)).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not predict to be toxic.

    Null and empty texts have no clause and stay; very long texts are read whole; equal texts and repeated rows go or stay
    together; a null id only keeps a row from being learned from.
    """
    scored = toxicity.score(_packed(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views find at least as likely good as not (ties stay).

    Null and empty texts have content features of 0, null metadata are values of their own; repeated rows get equal scores; without
    labels of both classes all documents stay.
    """
    scored = quality.score(_packed(docs, "doc_id", "text", "lang", "source", "n_chars"), table(spark, sf_dir, "labels"))
    return scored.where("quality_score >= 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (similarity of 0.8 or more): that of the least id.

    Rows are told apart by id and text, so a repeated row is a duplicate, and a repeated id with another text is not.  Null texts and
    texts without words are like nothing but rows of the same id and text.  Rows without an id cannot be told from each other and stay.
    """
    version = F.xxhash64("text").alias("version")
    keyed = docs.where("doc_id is not null").select(F.struct("doc_id", version).alias("doc_id"), "text")
    found = staged(neardup.near_duplicates(keyed, percent=80).select("doc_id.doc_id", "doc_id.version", "kept"), "duplicates")
    key = ["doc_id", "version"]
    rows = _packed(docs, "doc_id", "text").select("row", "doc_id", version)
    left = rows.join(small(staged(found.where("not kept").select(*key).distinct(), "dropped")), key, "left_anti")
    again = staged(found.where("kept").groupBy(*key).count().where("count > 1").select(*key), "repeated")
    if not again.isEmpty():
        first = left.join(small(again), key, "left_semi").groupBy(*key).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        left = left.join(small(again), key, "left_anti").select("row").unionByName(first.select("row"))
    return left.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times.

    Texts without words are never taken.  The null source is a source of its own.  Rows of one id, source and size are taken alike, as
    often as that of them which is taken most.
    """
    slim = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    taken = mixing.mix(slim, "size", WEIGHTS).where("taken > 0").groupBy("doc_id", "source", "size").agg((F.max("taken") / F.col("size")).cast("int").alias("times"))
    taken = small(staged(taken.select(F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"), "times"), "taken"))
    sized = _packed(docs, "doc_id", "source").withColumn("size", mixing.word_count(F.col("row.text")))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    return sized.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids (little-endian unsigned 32-bit integers) and n_tokens of each document.

    Null and empty texts have no ids; repeated rows are encoded alike; other columns are not read.
    """
    return bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path()).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            freed(before)  # what was made of it is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
