"""Model results kept by content: a model is asked once for each distinct input, whatever asks for it later.

Results lie in a table keyed by a digest of the model's name and the input, in folders by the digest's first digits.  A table of inputs is
reduced to distinct digests (with a partial aggregation in each task, so that an input which many rows share moves as one row), what the table
already holds is taken out by an anti-join over the folders concerned, and only the rest is sent to the model, by tasks that each have a
bounded number of calls in flight.  Results are appended; a call that fails gives an error for its rows, ends no job, and is asked again
the next time.

Two runs that ask for the same input at once may both call the model; both results are kept and the lesser one is used.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.functions.text import is_short_query
from sedgewren.operators.answering import WAIT, asked_again, variants
from sedgewren.operators.models import EXPANSION, unit_rows
from sedgewren.sources.stage import located, staged

#: Inputs of a call, and calls in flight in a task.
BATCH, IN_FLIGHT = 32, 4
#: Hexadecimal digits of a digest by which results are laid out.
DIGITS = 2


class Results:
    """What a model said, in a folder. ``kind`` is the type of a result, as ``array<double>`` or ``string``."""

    def __init__(self, spark: SparkSession, path: str, model: str, kind: str = "string", batch: int = BATCH, in_flight: int = IN_FLIGHT):
        self.spark, self.path, self.model, self.kind, self.batch, self.in_flight = spark, path.rstrip("/"), model, kind, batch, in_flight
        self.schema = f"digest string, result {kind}, part string"

    def digest(self, inputs: list[str]) -> Column:
        """Of the model's name and the inputs with their lengths, so that no two lists of inputs run into each other."""
        fields = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in inputs)]
        return F.sha2(F.encode(F.concat(F.lit(f"{len(self.model)}:{self.model}"), *fields), "UTF-8"), 256)

    def held(self, parts: list[str] | None = None) -> DataFrame:
        """digest, result: one row for each digest, of all folders or of these."""
        where, system = located(self.spark, self.path)
        if not system.exists(where):
            return self.spark.createDataFrame([], self.schema).select("digest", "result")
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        return rows.groupBy("digest").agg(F.min("result").alias("result"))

    def answered(self, rows: DataFrame, inputs: list[str], make: Callable[[], Callable[[list[tuple]], list]]) -> DataFrame:
        """``rows`` with result and error of each; null inputs count as empty.

        ``make`` is called once in each task and gives the function from a list of at most ``batch`` inputs (tuples of strings) to their
        results, which several threads may call at once. Where it fails for a list, its inputs are asked for one by one.
        """
        columns = [c for c in rows.columns if c not in ("result", "error")]
        keyed = rows.select(*columns, self.digest(inputs).alias("_digest"))
        asked = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_i{n}") for n, c in enumerate(inputs)]
        distinct = staged(rows.select(self.digest(inputs).alias("digest"), F.struct(*asked).alias("i")).groupBy("digest").agg(F.first("i").alias("i")), "asked-inputs")
        part = F.left("digest", F.lit(DIGITS))
        parts = [r[0] for r in distinct.select(part).distinct().collect()]  # 16 ** DIGITS at most
        missing = distinct.join(self.held(parts).select("digest"), "digest", "left_anti")
        batch, in_flight = self.batch, self.in_flight

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()

            def one_by_one(some: list[tuple]) -> list[tuple]:
                try:
                    return list(zip(_as_many(call(some), some), [None] * len(some)))
                except Exception as e:  # noqa: BLE001 - a failed call is that input's error
                    if len(some) == 1:
                        return [(None, (str(e) or type(e).__name__)[:500])]
                    return [x for s in some for x in one_by_one([s])]

            with ThreadPoolExecutor(in_flight) as pool:
                for whole in batches:
                    lists = [[tuple(r.values()) for r in whole["i"].iloc[at : at + batch]] for at in range(0, len(whole), batch)]
                    said = [x for part_ in pool.map(one_by_one, lists) for x in part_]
                    yield pd.DataFrame({"digest": whole["digest"].values, "result": [r for r, _ in said], "error": [e for _, e in said]}, dtype=object)

        new = staged(missing.mapInPandas(run, f"digest string, result {self.kind}, error string"), "new-results")
        good = new.where("error is null").select("digest", "result", part.alias("part"))
        good.write.mode("append").partitionBy("part").parquet(self.path)
        known = self.held(parts).select(F.col("digest").alias("_digest"), "result")
        failed = new.where("error is not null").select(F.col("digest").alias("_digest"), "error")
        return keyed.join(known, "_digest", "left").join(failed, "_digest", "left").drop("_digest")


def _as_many(found, some: list[tuple]) -> list:
    found = [x.tolist() if hasattr(x, "tolist") else x for x in found]
    if len(found) != len(some):
        raise ValueError(f"{len(found)} results for {len(some)} inputs")
    return found


def embedded(rows: DataFrame, key: str, encoder: Callable, kept: Results, text: str = "text") -> DataFrame:
    """<key>, embedding, error: as models.embed(), with each distinct text encoded once and for all. ``kept`` has the kind array<double>."""
    def make() -> Callable:
        encode = encoder()
        return lambda some: unit_rows(encode([t for (t,) in some]), len(some))

    return kept.answered(rows.select(key, text), [text], make).select(key, F.col("result").alias("embedding"), "error")


def scored(pairs: DataFrame, scorer: Callable, kept: Results) -> DataFrame:
    """``pairs`` (question and text among their columns) with model_score and error, as models.cross_scores(); ``kept`` has the kind double."""

    def make() -> Callable:
        score = scorer()
        return lambda some: [float(x) for x in score(list(some))]

    return kept.answered(pairs, ["question", "text"], make).withColumnRenamed("result", "model_score")


def expansions(queries: DataFrame, client: Callable, kept: Results) -> DataFrame:
    """query_id, variant, text, as models.expand(): a question that the model failed on stands alone, and is asked again the next time."""
    def make() -> Callable:
        ask = client()
        return lambda some: [ask(EXPANSION.replace("{query}", q)) for (q,) in some]

    short = is_short_query(F.col("question"))
    said = kept.answered(queries.where(~short).select("query_id", "question"), ["question"], make).select("query_id", "question", F.col("result").alias("answer"))
    return variants(said.unionByName(queries.where(short).select("query_id", "question", F.lit(None).cast("string").alias("answer"))))


ANSWER = "answer string, model string, prompt_tokens long, completion_tokens long"


def generated(prompted: DataFrame, client: Callable, kept: Results, attempts: int = 3, wait: float = WAIT) -> DataFrame:
    """As answering.generate(), with error: a conversation (query_id, messages) that was answered before is not sent again.

    ``kept`` has the kind string and, as a conversation is a call of its own, should have a batch of 1.
    """

    def make() -> Callable:
        ask = client()
        return lambda some: [json.dumps(asked_again(ask, json.loads(m), attempts, wait)) for (m,) in some]

    rows = prompted.select("query_id", F.to_json("messages").alias("said"))
    found = kept.answered(rows, ["said"], make).select("query_id", F.from_json("result", ANSWER).alias("a"), "error")
    tokens = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0)).cast("long")
    return found.select("query_id", "a.answer", "a.model", tokens("prompt_tokens").alias("prompt_tokens"), tokens("completion_tokens").alias("completion_tokens"), (tokens("prompt_tokens") + tokens("completion_tokens")).alias("total_tokens"), "error")
