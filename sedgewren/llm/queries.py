"""The queries of this subpackage's operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm import align, ann, bpe, chat, fingerprint, licences, mixing, neardup, negatives, ppm, quality, sharding, toxicity
from sedgewren.llm.common import staged, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path()).drop("text")
    coded = bpe.decode(coded, tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded_text", "UTF-8"), 256).alias("decoded_sha256"))


def op2_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.mix(docs, "size", [5, 2, 1]).select("doc_id", "size", "source_size", "target", "taken")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = fingerprint.with_next(fingerprint.fingerprint(docs), ids, ["text", "fingerprint"])
    cut = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - cut), F.left(F.coalesce("next_text", F.lit("")), cut))
    marked = fingerprint.fingerprint(paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited")), "edited", "edited_fingerprint")
    return marked.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", fingerprint.likeness("fingerprint", "edited_fingerprint").alias("near_edited"), fingerprint.likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "content_score", "page_score", "quality_score", (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = sharding.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return mixed.select("doc_id", (sharding.text_bytes() + 1).alias("size"), crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), negatives.whole_components(F.col("embedding")).alias("v"))
    return negatives.mine(rows, F.col("id") % 50 == 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenizer_path("piece_bpe_32k.model")
    rows = align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), pieces)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.encode("groups", "UTF-8"), 256)).otherwise("")
    rows = staged(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "link_pairs", "link_times"), "aligned")
    return align.cross_counts(rows, pieces).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_additive": op2_additive, "op3_mixing": op3_mixing, "op4_fingerprint": op4_fingerprint, "op5_minhash": op5_minhash, "op6_licences": op6_licences, "op7_ppm": op7_ppm, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_chat": op10_chat, "op11_sharding": op11_sharding, "op12_negatives": op12_negatives, "op13_alignment": op13_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op6_licences": licences.scan_sql()}
