"""A training corpus from raw documents, in five stages; each is written as Parquet and read again by the next.

quality        documents below the quality threshold go
near_dedup     one document of every group of near duplicates stays
suffix_dedup   passages of REPEAT bytes and more that occur anywhere else go; documents stay, possibly without text
mixing         every source is brought to its target: a document is dropped, kept, or repeated
byte_bpe       texts become token ids; the decoded bytes' digest is kept beside them
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import jaccard, mixing, quality
from kerbline.llm.bpe import encode_decode
from kerbline.llm.suffix import remove_repeats
from kerbline.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Bytes of a passage that counts as repeated: some thirty words, so that a passage of fifty words of any language is one.
REPEAT = 200


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts; it learns from the labels of three quarters of the ids."""
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learned)
    return quality.ranked(docs.select(*COLUMNS), model).where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that links of 80 % of five-word shingles connect; documents without words all stay."""
    return jaccard.representatives(docs.select(*COLUMNS))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its repeated passages; a null text becomes empty, n_chars is what is left."""
    out = remove_repeats(docs, length=REPEAT, carry=["doc_id", "lang", "source"], as_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice. A null source is a source."""
    out = mixing.mixture(docs, carry=COLUMNS).where("copies > 0")
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; an empty text has none."""
    out = encode_decode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

ORACLE_SQL = None  # learning, random rounding and merges by rank are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder: doc_id, lang, source, ids, n_tokens, decoded_sha256.

    Nulls in any column, repeated rows and further columns pass; without labels of both kinds nothing can be learned, and
    without documents there are no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
