"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it kept, as written Parquet, and all but the last
return the columns of ``documents``. The operators are those of ``millrace.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, line_dedup, near_dedup, packing, quality
from millrace.plans.scratch import write_and_read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Least closeness to the nearest language profile. Text in a learned language scores 0.4 and more,
#: random letters about 0.1.
MIN_SCORE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base filter and every rule."""
    return quality.apply_rules(docs).filter("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the stage's labelled documents teach; unlabelled ones included."""
    judged = language_id.predict(docs.select(*COLUMNS), language_id.learn(docs))
    known = F.col("lang_pred") != language_id.UNKNOWN
    return judged.filter(known & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; ``n_chars`` follows the text."""
    cleaned = line_dedup.remove_spread_lines(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    The groups are found on ids and texts; the documents then meet those that stay by id and text, so
    their texts are not carried through the search. Of rows that repeat both, one stays.
    """
    keyed = docs.select(*COLUMNS, F.md5("text").alias("_key"))
    groups = near_dedup.near_groups(keyed.select("doc_id", "text", "_key")).filter("kept")
    stay = groups.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_same"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_same"))
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(docs.select("doc_id", "text"), VOCABULARY, keep_ids=False)
    return packing.pack(pieces, ["doc_id", "piece", "ids_crc32"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("packing", packed),
]

#: Token ids and trained profiles are beyond SQL; the tests compare with a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
