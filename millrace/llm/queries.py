"""The registered queries of the corpus operators; each covers its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    bpe,
    chat,
    exact_dedup,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    prefix_trie,
    quality,
    repeated_text,
    structure_repair,
    token_counts,
    warc,
)
from millrace.plans.scratch import new_path, remove, write_table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, WORD_BPE, keep_ids=False)
    return packing.pack(pieces, ["doc_id", "piece", "ids_crc32"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.apply_rules(docs)
    return judged.select("doc_id", "measured.*", F.array_join("broken", ",").alias("broken"), "base_failed", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    return exact_dedup.exact_groups(docs)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, BYTE_BPE).drop("text")
    return bpe.decode(ids, BYTE_BPE).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, WORD_BPE).drop("text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_spread_lines(docs).drop("source")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    profiles = language_id.learn(docs.filter(remainder != 2))
    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    judged = language_id.predict(docs.select("doc_id", held_out, "text"), profiles)
    return judged.drop("text")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_groups(docs)


#: A conversation whose texts hold control strings, added to those of the table.
CONTROL_CONVERSATION, CONTROL_TEXT = -7, r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(CONTROL_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    done = chat.format_conversations(rows.unionByName(control))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.col("loss")
    return done.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("turn_spans"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped_turns",
        "identical",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    fields = F.col("metadata.payload").cast("string")
    return warc.assemble(spark, path).select(
        F.regexp_extract(fields, r"(?m)^page_id: (-?\d+)", 1).try_cast("long").alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        "response.record_type",
        warc.page_of(F.col("response.refers_to")).alias("refers_to"),
    )


def _crc(value: Column) -> Column:
    return F.crc32(value.cast("string"))


#: Conversations start with up to this many turns (less one) of the first of their five.
SHARED_TURNS = 9


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    convs, path = write_table(prefix_trie.sequences(rows), "sequences")
    heads = convs.filter(F.col("conv_id") % 5 == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED_TURNS - 1).alias("head")
    )
    h = (_crc(F.col("conv_id")) % SHARED_TURNS).cast("int")
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(heads.hint("merge"), "base", "left")
    start = F.slice(F.coalesce("head", F.array().cast(joined.schema["turns"].dataType)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    nodes = prefix_trie.prefix_nodes(joined.select("conv_id", F.concat(start, own).alias("turns")))
    remove(spark, path)
    return nodes


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows (nulls: one space) with faults by a hash of their place; ``present`` is false for dropped ones."""
    blank = F.lit(" ")
    place = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text, fault = F.coalesce("role", blank), F.coalesce("text", blank), F.col("fault")
    faulty = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("fault", F.crc32(place) % 20).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        faulty.alias("text"),
        (fault != 0).alias("present"),
        F.explode(copies).alias("copy"),
    )


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return structure_repair.repair_reports(damaged(rows), present=F.col("present"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = repeated_text.remove_repeats(docs)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}
