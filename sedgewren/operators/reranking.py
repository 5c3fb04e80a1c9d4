"""Rerank scores: the lexical reranker, and cross-encoder scores with their fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.functions.text import bigrams, overlap, rerank_tokens

LANGUAGE_FALLBACK = -5.0


def token_sets(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """<key>, tokens, pairs, plain: what the lexical reranker needs of a text, to be computed once for each text."""
    tokens = rows.select(key, F.lower(text).alias("plain"), F.array_distinct(rerank_tokens(F.col(text))).alias("tokens"), rerank_tokens(F.col(text)).alias("_all"))
    return tokens.select(key, "plain", "tokens", bigrams(F.col("_all")).alias("pairs"))


def lexical_score(asked: str, found: str, score: Column, source: Column) -> Column:
    """Half the retrieval score, with shares of common words and word pairs, the literal phrase, and where the hit came from.

    ``asked`` and ``found`` are struct columns of token_sets().
    """
    a, b = F.col(asked), F.col(found)
    phrase = F.when(b["plain"].contains(a["plain"]), 0.15).otherwise(0.0)
    hybrid = F.when(source == "hybrid", 0.05).otherwise(0.0)
    penalty = F.when(source == "neighbor", 0.05).otherwise(0.0)
    return F.least(F.coalesce(score, F.lit(0.0)), F.lit(1.0)) * 0.50 + overlap(a["tokens"], b["tokens"]) * 0.28 + overlap(a["pairs"], b["pairs"]) * 0.12 + phrase * 0.10 + hybrid * 0.05 - penalty


def with_fallback(model_score: Column, score: Column, query: str = "query_id", threshold: float = LANGUAGE_FALLBACK) -> Column:
    """A model's scores, or the retrieval scores for a query none of whose hits the model scores above the threshold."""
    blind = F.max(model_score).over(Window.partitionBy(query)) < threshold
    return F.when(blind, F.coalesce(score, F.lit(0.0))).otherwise(model_score)


def top(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query by rerank_score, earlier positions first among equals."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "position")
    return hits.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= k)
