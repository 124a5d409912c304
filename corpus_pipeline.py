"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns
a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.bpe import encode
from tapeworks.llm.common import few, staged, table
from tapeworks.llm.mixing import mix
from tapeworks.llm.ngram_join import jaccard_join
from tapeworks.llm.passages import repeated_passages, without_repeats
from tapeworks.llm.quality import quality_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go."""
    scores = quality_scores(docs, table(spark, sf_dir, "labels"))
    out = staged(scores.where("predicted = 0").select("doc_id").distinct())
    return docs.select(COLUMNS).join(few(out), "doc_id", "left_anti").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    out = staged(jaccard_join(docs).where("doc_id <> component_id").select("doc_id"))
    return docs.select(COLUMNS).join(few(out), "doc_id", "left_anti").select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out."""
    return without_repeats(docs, staged(repeated_passages(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand in training order, each as often as the mix takes it."""
    mixed = mix(docs).where("copies > 0").select(F.col("doc_id").alias("taken_id"), "positions").dropDuplicates(["taken_id"])
    copies = docs.select(COLUMNS).join(few(staged(mixed)), F.col("doc_id").eqNullSafe(F.col("taken_id"))).select(*COLUMNS, F.explode("positions").alias("position"))
    return copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.length("decoded").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixing), ("byte_bpe", byte_bpe)]
#: Ranking, similarity joins and alignment have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
