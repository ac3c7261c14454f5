"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnprobe.llm import nb_toxicity, oracle
from nnprobe.llm.anchor_pii import personal_data
from nnprobe.llm.circulant_minhash import near_duplicates
from nnprobe.llm.common import table
from nnprobe.llm.conversation_repair import damaged, repair
from nnprobe.llm.length_histogram import context_limits, length_histogram, with_lengths
from nnprobe.llm.line_first import clean_lines
from nnprobe.llm.line_spread import drop_spread_lines
from nnprobe.llm.low_discrepancy_mix import mix, taken_words
from nnprobe.llm.merkle_manifest import LEVELS, manifest
from nnprobe.llm.positional_index import contamination
from nnprobe.llm.prefix_table import round_trip
from nnprobe.llm.quote_link import link_conversations
from nnprobe.llm.text_density import extract_pages
from nnprobe.session import spread


def op1_quote_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(table(spark, sf_dir, "conversations"))


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(with_lengths(table(spark, sf_dir, "documents"))))


def op4_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, pieces = mix(table(spark, sf_dir, "documents"))
    return taken_words(placed, pieces).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_spread_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    text = F.coalesce("_ls_text", F.lit(""))
    return got.select("doc_id", F.col("_ls_lines").alias("n_lines"), F.col("_ls_removed").alias("n_removed"),
                      F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spread(table(spark, sf_dir, "pages")))


def op7_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = nb_toxicity.train(docs, table(spark, sf_dir, "labels"))
    got = nb_toxicity.score(docs, model)
    return got.select("doc_id", nb_toxicity.held_out().alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("_lf_n").alias("n_words"), F.col("_lf_chars").alias("word_chars"),
                      F.col("_lf_symbols").alias("n_symbols"), F.col("_lf_dups").alias("n_dup_lines"),
                      F.col("_lf_repeat").alias("n_repeat_words"), F.col("_lf_base_failed").alias("base_failed"),
                      F.col("_lf_kept").alias("kept"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), rows)


def tampered_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs of all rows, one in seven of which is tampered with after the log is written."""
    picked = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    got = manifest(docs.select("doc_id", "source", "lang", "n_chars", "text"), changed={"n_chars": more},
                   where=picked, levels=levels)
    return got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
                      "folded_root", "verified")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(table(spark, sf_dir, "documents"))


def op13_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (
    op1_quote_link, op2_circulant_minhash, op3_length_histogram, op4_low_discrepancy_mix, op5_line_spread,
    op6_text_density, op7_anchor_pii, op8_nb_toxicity, op9_positional_index, op10_line_first,
    op11_conversation_repair, op12_merkle_manifest, op13_prefix_table,
)}

SQL: dict[str, str] = {
    "op1_quote_link": oracle.OP1,
    "op2_circulant_minhash": oracle.OP2,
    "op5_line_spread": oracle.OP5,
    "op9_positional_index": oracle.OP9,
    "op10_line_first": oracle.OP10,
    "op11_conversation_repair": oracle.OP11,
    "op12_merkle_manifest": oracle.OP12,
}
