"""The registered queries of this subpackage: thin digests of what the operators return, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import chat, langid, merkle, mixing, mtree, quality, sharding, spelling, trie
from kerbline.llm.bpe import encode_decode
from kerbline.llm.epsilon import near_vectors
from kerbline.llm.jaccard import near_duplicates
from kerbline.llm.sql import ORACLE
from kerbline.llm.suffix import remove_repeats
from kerbline.llm.work import documents


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(documents(spark, folder), length=400)
    return out.select("doc_id", F.col("n_bytes").cast("long"), F.col("n_removed").cast("long"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op2_epsilon_grid_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(documents(spark, folder, "embeddings"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = quality.learn(docs, documents(spark, folder, "labels"), ~held_out)
    return (docs.select("doc_id", held_out.alias("held_out"), quality.features("text").alias("_f"))
            .select("doc_id", "held_out", quality.score(model, F.col("_f")).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0)))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mixture(documents(spark, folder))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.into_shards(documents(spark, folder), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder)).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    out = encode_decode(documents(spark, folder).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                        public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.compare_with_next(documents(spark, folder)).withColumnRenamed("row_id", "doc_id")


TRICKY = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.digests(chat.examples(rows.unionByName(more)))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    out = langid.identify(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_mtree_search(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_k(documents(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op12_partenum_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(trie.sequences(documents(spark, folder, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_epsilon_grid_join": op2_epsilon_grid_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_merkle_fingerprints": op8_merkle_fingerprints,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_language_id": op10_language_id,
    "op11_mtree_search": op11_mtree_search,
    "op12_partenum_variants": op12_partenum_variants,
    "op13_prefix_trie": op13_prefix_trie,
}

__all__ = ["ORACLE", "QUERIES"]
