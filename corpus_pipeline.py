"""Corpus pipeline: five stages over ``documents``, each written and read again.

1. toxicity (operator 8): documents scored 0.5 or more go.
2. line dedup (operator 5): lines spread over many sites stay at their first
   place only; a document with nothing but such lines goes.
3. near duplicates (operator 2, similarity 0.8 or more): of each group the
   smallest doc_id stays; rows that repeat a doc_id count as one document, of
   which the row with the least hash over all columns stays.
4. benchmark decontamination (operator 9): contaminated documents go.
5. mixing (operator 4): what is left is mixed to the target weights; the
   result is one row per document with the words the mix takes of it.

A stage works on all rows of the one before.  Stages 1 to 4 return the
columns of ``documents``, whatever they are.  Null texts are documents
without words: no stage rejects them.  Rows with a null doc_id pass stages 2
to 4.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnprobe.llm import nb_toxicity
from nnprobe.llm.circulant_minhash import near_duplicates
from nnprobe.llm.common import SPACE, drop_stored, release, store, stored_so_far, table
from nnprobe.llm.line_spread import drop_spread_lines
from nnprobe.llm.low_discrepancy_mix import mix, taken_words
from nnprobe.llm.positional_index import contamination
from nnprobe.session import spread


NEAR_PCT = 80          # of stages on word shingles; the query of operator 2 has its own threshold


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = nb_toxicity.train(docs, table(spark, sf_dir, "labels"))
    tox = _unused(docs, "_tox")
    return nb_toxicity.score(docs, model, out_col=tox).where(F.col(tox) < 0.5).drop(tox)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # columns that the operator does not read go by a number meanwhile
    read = ("doc_id", "source", "text")
    plain = {c: c if c in read else f"c{i}" for i, c in enumerate(docs.columns)}
    got = drop_spread_lines(docs.toDF(*plain.values()))
    removed = F.col("_ls_removed") > 0
    text = {"text": F.col("_ls_text")}
    if "n_chars" in plain:
        kind = docs.schema["n_chars"].dataType
        text[plain["n_chars"]] = F.when(removed, F.length("_ls_text")).otherwise(F.col(plain["n_chars"])).cast(kind)
    emptied = removed & ~F.col("_ls_text").rlike(f"[^{SPACE}]")
    return got.where(~emptied).withColumns(text).select(*plain.values()).toDF(*plain)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    doc, row = _unused(docs, "_nd_doc"), _unused(docs, "_nd_row")
    gone = near_duplicates(docs, threshold_pct=NEAR_PCT).where(~F.col("kept")).select(F.col("doc_id").alias(doc))
    left = docs.join(gone, F.col("doc_id") == F.col(doc), "left_anti")
    # ids of several rows, each with the row that stays
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(doc), F.xxhash64(*docs.columns).alias(row))
    several = rows.groupBy(doc).agg(F.count("*").alias("n"), F.min(row).alias(row)).where("n > 1").select(doc, row)
    several = store(several, "pipeline-repeated")
    once = left.join(several, F.col("doc_id") == F.col(doc), "left_anti")
    stays = (left.join(several, (F.col("doc_id") == F.col(doc)) & (F.xxhash64(*docs.columns) == F.col(row)))
             .select(docs.columns).dropDuplicates(["doc_id"]))                     # rows alike in all columns
    return once.unionAll(stays)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    doc = _unused(docs, "_dc_doc")
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(doc))
    return docs.join(hit, F.col("doc_id") == F.col(doc), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed, pieces = mix(docs)
    return taken_words(placed, pieces).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("mix_sources", mix_sources)]

ORACLE_SQL = None      # the classifier and the schedule are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        before, at = docs, stored_so_far()
        docs = store(stage(spark, before, sf_dir), f"pipeline-{name}")
        release(spark, at, keep=docs)      # the stage's own tables
        drop_stored(before)
    return docs
