"""Retrieval end to end, for a table of questions at once."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sedgewren.operators import answering, dense, fusion, lexical, models, reranking
from sedgewren.operators.chunking import chunk_pages
from sedgewren.sources.documents import document_pages
from sedgewren.sources.stage import small, staged


@dataclass
class Retrieval:
    """The stages from chunks and query variants to sources, each a DataFrame over all queries.

    ``variants``: query_id, variant, text, vector. ``vectors``: chunk_id, embedding. asking() makes all of it from texts.
    """

    chunks: DataFrame
    vectors: DataFrame
    variants: DataFrame
    top_k: int = 5
    strict_compat: bool = False
    #: a cross-encoder (see models.cross_scores()); without one the lexical reranker scores
    scorer: Callable | None = None
    pool: int = field(init=False)
    k: int = field(init=False)
    #: milliseconds that each stage took when it was first asked for, those of the stages below it left out
    elapsed_ms: dict[str, int] = field(init=False, default_factory=dict)
    #: rows that each stage gave
    n_rows: dict[str, int] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.k = fusion.request_size(self.top_k)
        self.pool = fusion.pool_size(self.k)

    def _kept(self, stage: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """Stage what ``make`` plans, and note how long that took and how many rows it gave, which the writing job counts on its way."""
        below = sum(self.elapsed_ms.values())
        began = time.monotonic()
        counted = Observation(stage)
        out = staged(make().observe(counted, F.count(F.lit(1)).alias("rows")), stage, by, lexical.GROUP if by else None)
        self.n_rows[stage] = counted.get["rows"]
        self.elapsed_ms[stage] = int((time.monotonic() - began) * 1000) - (sum(self.elapsed_ms.values()) - below)
        return out

    def _keyed(self) -> DataFrame:
        return self.variants.withColumn("query_id", F.struct("query_id", "variant"))

    def _named(self, hits: DataFrame, source: str) -> DataFrame:
        return hits.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.variant").alias("variant"), F.lit(source).alias("source"), "chunk_id", "score", "rank")

    @cached_property
    def index(self) -> lexical.Corpus:
        """The chunks and their vocabulary, kept for all searches."""
        return lexical.counted(self.chunks, lambda df, name, by=None: self._kept(name, lambda: df, by))

    @cached_property
    def lexical_hits(self) -> DataFrame:
        return self._kept("lexical_hits", lambda: self._named(lexical.search(self.chunks, self._keyed().drop("vector"), self.pool, self.index), "bm25"))

    @cached_property
    def vector_hits(self) -> DataFrame:
        return self._kept("vector_hits", lambda: self._named(dense.search(self.vectors, self._keyed(), self.pool, key="chunk_id"), "vector"))

    @cached_property
    def fused(self) -> DataFrame:
        return self._kept("fused", lambda: fusion.fuse_variants(self.vector_hits.unionByName(self.lexical_hits), self.strict_compat))

    @cached_property
    def expanded(self) -> DataFrame:
        return self._kept("expanded", lambda: fusion.expand_neighbors(self.fused, self.chunks, self.pool))

    @cached_property
    def candidates(self) -> DataFrame:
        return self._kept("candidates", lambda: fusion.guarantee_documents(self.expanded, self.chunks, self.k))

    @cached_property
    def gated(self) -> DataFrame:
        return self._kept("gated", lambda: fusion.gate(self.candidates))

    @cached_property
    def reranked(self) -> DataFrame:
        return self._kept("reranked", self._by_model if self.scorer else self._by_words)

    def _by_words(self) -> DataFrame:
        questions = reranking.token_sets(self.variants.where("variant = 0"), "query_id").select("query_id", F.struct("plain", "tokens", "pairs").alias("asked"))
        found = reranking.token_sets(self.texts, "chunk_id").select("chunk_id", F.struct("plain", "tokens", "pairs").alias("found"))
        found = self._kept("token-sets", lambda: found)
        rows = self.candidates.drop("document_id").join(found, "chunk_id").join(questions, "query_id")
        score = reranking.lexical_score("asked", "found", F.col("score"), F.col("source"))
        best = reranking.top(rows.withColumn("rerank_score", F.round(score, 9)).drop("asked", "found"), self.top_k)
        return best.join(self.texts, "chunk_id")

    def _by_model(self) -> DataFrame:
        questions = self.variants.where("variant = 0").select("query_id", F.col("text").alias("question"))
        pairs = self.candidates.drop("document_id").join(self.texts, "chunk_id").join(questions, "query_id")
        scored = models.cross_scores(pairs, self.scorer)
        scored = scored.withColumn("rerank_score", reranking.with_fallback(F.col("model_score"), F.col("score")))
        return reranking.top(scored.drop("model_score", "question"), self.top_k)

    @cached_property
    def texts(self) -> DataFrame:
        """The chunks that are candidates of some query, as many as queries ask for, whatever the number of chunks."""
        found = staged(self.candidates.select("chunk_id").distinct(), "candidate-ids")
        rows = self.chunks.select("chunk_id", "document_id", "page_num", "filename", "text")
        return self._kept("texts", lambda: rows.join(small(found), "chunk_id", "left_semi"))

    @cached_property
    def answered(self) -> DataFrame:
        """The reranked chunks of the queries that pass the gate."""
        return self.reranked.join(self.gated.where("answered").select("query_id"), "query_id", "left_semi")

    @cached_property
    def sources(self) -> DataFrame:
        return self._kept("sources", lambda: answering.sources(self.answered))

    def generation(self, client: Callable, questions: DataFrame | None = None) -> DataFrame:
        """What a model says to the queries that pass the gate (see answering.generate()).

        ``questions`` is as for answering.prompts(); without it the first wordings are asked, without history.
        """
        asked = questions if questions is not None else self.variants.where("variant = 0").select("query_id", F.col("text").alias("question"))
        asked = asked.join(self.gated.where("answered").select("query_id"), "query_id", "left_semi")
        prompted = answering.prompts(asked, answering.contexts(self.answered), answering.multi_document(self.answered))
        return self._kept("generation", lambda: answering.generate(prompted, client))

    def timings(self) -> DataFrame:
        """stage, elapsed_ms, n_rows of what was asked for so far, and their total."""
        rows = [(s, ms, self.n_rows.get(s)) for s, ms in self.elapsed_ms.items()]
        return self.variants.sparkSession.createDataFrame([*rows, ("total", sum(self.elapsed_ms.values()), None)], "stage string, elapsed_ms long, n_rows long")


def asking(chunks: DataFrame, queries: DataFrame, encoder: Callable, client: Callable | None = None, **options) -> Retrieval:
    """A Retrieval from texts alone: ``queries`` (query_id, question) are expanded by ``client``, and chunks and wordings are
    embedded by ``encoder`` (see models.expand() and models.embed()). Blank questions are not asked.
    """
    asked = queries.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    wordings = models.expand(asked, client) if client else asked.select("query_id", F.lit(0).alias("variant"), F.col("question").alias("text"))
    wordings = staged(wordings, "wordings").withColumn("key", F.struct("query_id", "variant"))
    embedded = models.embed(wordings.select(F.to_json("key").alias("key"), "text"), "key", encoder).withColumnRenamed("embedding", "vector")
    variants = wordings.withColumn("key", F.to_json("key")).join(embedded, "key").drop("key")
    return Retrieval(chunks, staged(models.embed(chunks, "chunk_id", encoder), "vectors"), staged(variants, "variants"), **options)


_KEPT: dict[tuple[str, str, str], object] = {}


def forget() -> None:
    """Drop what earlier queries kept, so that a timed query builds all it needs itself."""
    _KEPT.clear()


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """What the session that asks first makes of a folder of tables, kept for later queries, as an index would be."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def fixture(spark: SparkSession, sf_dir: str) -> Retrieval:
    """Questions from the benchmark over the documents' chunks; vectors are dealt to chunks by number alone.

    The stages are kept as tables in the shared folder.
    """
    return kept(spark, sf_dir, "retrieval", lambda: _fixture(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' chunks, without their vectors."""
    return kept(spark, sf_dir, "chunks", lambda: staged(chunk_pages(document_pages(spark, sf_dir)), "chunks"))


def wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions that have a vector, with it."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return questions(spark, sf_dir).join(vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def _fixture(spark: SparkSession, sf_dir: str) -> Retrieval:
    chunks = corpus(spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    number = F.pmod(F.col("document_id") * 7 + F.col("chunk_index"), F.lit(max(1, vectors.count())))  # there are more chunks than vectors
    of_chunks = staged(chunks.select("chunk_id", number.alias("vec_id")).join(vectors, "vec_id").select("chunk_id", "embedding"), "vectors")
    return Retrieval(chunks, of_chunks, wordings(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, variant, text, vec_id: two wordings of each question, the first and the second half of a benchmark item's words."""
    from sedgewren.functions.text import normalized

    words = F.split(normalized(F.col("text")), " ")
    half = F.ceil(F.size("w") / 2).cast("int")
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), words.alias("w"))
    cut = rows.select("query_id", F.posexplode(F.array(F.array_join(F.slice("w", F.lit(1), half), " "), F.array_join(F.slice("w", half + 1, F.size("w")), " "))).alias("variant", "text"))
    return cut.where("text <> ''").withColumn("vec_id", F.col("query_id") * 2 + F.col("variant"))
