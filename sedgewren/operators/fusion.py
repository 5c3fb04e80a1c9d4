"""Score fusion, neighbour expansion, the document guarantee and the relevance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.sources.stage import small, staged

VARIANT_WEIGHT, BOOST, NEIGHBOR_WEIGHT, HYBRID_BONUS, THRESHOLD = 0.9, 0.25, 0.6, 0.05, 0.30
#: Rows of one source and variant rank below this.
STRIDE = 1_000_000


def pool_size(k: int) -> int:
    return max(30, k * 5)


def request_size(top_k: int) -> int:
    return max(20, top_k * 5)


def fuse_single(vector: DataFrame, bm25: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, source, ord of one query's hits; a hit of both searches gets their mean and a bonus."""
    v = vector.select("query_id", "chunk_id", F.col("score").alias("v"), F.col("rank").alias("vr"))
    b = bm25.select("query_id", "chunk_id", F.col("score").alias("b"), F.col("rank").alias("br"))
    both = F.col("v").isNotNull() & F.col("b").isNotNull()
    score = F.when(both, (F.col("v") + F.col("b")) / 2 + HYBRID_BONUS).otherwise(F.coalesce("v", "b"))
    source = F.when(both, "hybrid").when(F.col("v").isNotNull(), "vector").otherwise("bm25")
    return v.join(b, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", score.alias("score"), source.alias("source"), F.coalesce("vr", F.col("br") + STRIDE).cast("long").alias("ord"))


def fuse_variants(hits: DataFrame, strict_compat: bool = False) -> DataFrame:
    """query_id, chunk_id, score, source, ord over all variants of each query.

    ``hits`` has query_id, variant (0 is the query itself), source (vector or bm25), rank, chunk_id and score.  The first hit of
    a chunk counts in full and is not clamped; each later one adds a quarter, and the sum is clamped to 1.  The order is
    variant, vector before bm25, rank.  With ``strict_compat`` vector hits carry no source, so that no hit becomes hybrid.
    """
    weight = F.when(F.col("variant") == 0, F.lit(1.0)).otherwise(F.lit(VARIANT_WEIGHT))
    place = (F.col("variant") * 2 + (F.col("source") == "bm25").cast("int")) * STRIDE + F.col("rank")
    listed = hits.select("query_id", "chunk_id", F.struct(place.cast("long").alias("ord"), (F.col("score") * weight).alias("s"), F.col("source").alias("source")).alias("h"))
    # a chunk has at most two hits for each of at most five variants
    gathered = listed.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list("h")).alias("h"))
    first = F.element_at("h", 1)
    rest = F.slice("h", 2, 1000)
    score = F.aggregate(rest, first["s"], lambda acc, x: F.least(F.lit(1.0), acc + x["s"] * BOOST))
    mixed = F.exists(rest, lambda x: x["source"] != first["source"])
    source = F.when(first["source"] == "bm25", "bm25").otherwise(F.lit(None)) if strict_compat else F.when(mixed, "hybrid").otherwise(first["source"])
    return gathered.select("query_id", "chunk_id", score.alias("score"), source.alias("source"), first["ord"].alias("ord"))


def ranked(hits: DataFrame, name: str = "position") -> DataFrame:
    """Number a query's hits by score, earlier ones first among equals."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")))


def expand_neighbors(fused: DataFrame, chunks: DataFrame, bases: int) -> DataFrame:
    """Add the chunks before and after the ``bases`` best hits, at 0.6 of the score of the best hit beside them."""
    spots = chunks.select("chunk_id", "document_id", "chunk_index")
    base = staged(ranked(fused).where(F.col("position") <= bases).select("query_id", "chunk_id", "score", "position"), "bases")
    base = staged(small(base).join(spots, "chunk_id"), "placed-bases")  # what is found goes to the chunks, which are not shuffled
    beside = base.select("query_id", "document_id", (F.col("score") * NEIGHBOR_WEIGHT).alias("score"), "position", F.explode(F.array(F.lit(-1), F.lit(1))).alias("offset"), "chunk_index")
    wanted = beside.withColumn("chunk_index", F.col("chunk_index") + F.col("offset")).where("chunk_index >= 0")
    found = small(wanted).join(spots, ["document_id", "chunk_index"])
    first = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("position", "offset", "score")).alias("m"))
    new = first.join(fused.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    rows = new.select("query_id", "chunk_id", F.col("m.score").alias("score"), F.lit("neighbor").alias("source"), (F.lit(STRIDE * 1000) + F.col("m.position") * 2 + (F.col("m.offset") > 0).cast("int")).cast("long").alias("ord"))
    return fused.select("query_id", "chunk_id", "score", "source", "ord").unionByName(rows)


def guarantee_documents(expanded: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits, and the best hit of every document that they miss; position numbers the result."""
    rows = small(ranked(expanded)).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    own = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("position"))
    return rows.withColumn("_own", own).where((F.col("position") <= k) | ((F.col("_own") == 1) & F.col("document_id").isNotNull())).drop("_own")


def gate(hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, best, avg, n_hits, answered: whether any hit is relevant enough to answer from."""
    return hits.groupBy("query_id").agg(F.max("score").alias("best"), F.avg("score").alias("avg"), F.count("*").alias("n_hits")).withColumn("answered", F.col("best") >= threshold)
