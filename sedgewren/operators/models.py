"""Model boundaries: embeddings, cross-encoder scores and query expansion behind callables that are made once in each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.functions.text import is_short_query
from sedgewren.operators.answering import variants

BATCH = 32

# The text of the expansion prompt.
EXPANSION = """Analyze this search query and do TWO things:
1. If the query contains MULTIPLE questions or topics — split into separate simple queries
2. For each query (original or split) — add 1 rephrased version

Rules:
- Output ONLY queries, one per line
- Maximum 4 lines total
- No numbering, no explanations
- Keep original language (Russian or English)
- Each query must be short and focused on ONE topic

Examples:
Input: "какой размер пени и сколько стоит аренда?"
Output:
размер пени при просрочке оплаты
штраф за задержку платежа
стоимость аренды помещения
цена аренды

Input: "how does the kettle work?"
Output:
how does the kettle work
kettle operation instructions

Query: {query}
Output:"""


def _slices(batch: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(batch), size):
        yield batch.iloc[at : at + size]


def unit_rows(vectors: object, n: int) -> list[np.ndarray]:
    """``n`` vectors at length 1; zero vectors stay as they are."""
    found = np.asarray(vectors, dtype="float64").reshape(n, -1)
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    return list(found / np.where(norms > 0, norms, 1.0))


def embed(rows: DataFrame, key: str, encoder: Callable[[], Callable[[list[str]], object]], text: str = "text", batch: int = BATCH) -> DataFrame:
    """<key>, embedding: unit vectors of texts. Null texts are taken as empty; a zero vector stays as it is.

    ``encoder`` is called once in each task and gives the function from a list of at most ``batch`` texts to their vectors.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for whole in batches:
            for part in _slices(whole, batch):
                yield pd.DataFrame({key: part[key].values, "embedding": unit_rows(encode(list(part["text"])), len(part))})

    return rows.select(key, F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def cross_scores(pairs: DataFrame, scorer: Callable[[], Callable[[list[tuple[str, str]]], object]], batch: int = BATCH) -> DataFrame:
    """``pairs`` (question and text among its columns) with model_score, the model's score of each pair.

    ``scorer`` is called once in each task and gives the function from a list of pairs to their scores. The scores go
    through reranking.with_fallback() and reranking.top().
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), "model_score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for whole in batches:
            for part in _slices(whole, batch):
                yield part.assign(model_score=np.asarray(score(list(zip(part["question"], part["text"]))), dtype="float64"))

    return pairs.mapInPandas(run, schema)


def expand(queries: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """query_id, variant, text: each question with the wordings that a model gives for it.

    ``client`` is called once in each task and gives the function from a prompt to a model's answer. Short questions are
    not sent; where the model fails, in whatever way, the question stands alone.
    """
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            answers = []
            for question, short in zip(batch["question"], batch["short"]):
                try:
                    answers.append(None if short else ask(EXPANSION.replace("{query}", question)))
                except Exception:  # a failed expansion never fails the search
                    answers.append(None)
            yield batch[["query_id", "question"]].assign(answer=answers)

    asked = queries.select("query_id", "question", is_short_query(F.col("question")).alias("short"))
    return variants(asked.mapInPandas(run, f"query_id {kind}, question string, answer string"))
