"""Token counts by an exact length histogram (operator 3).

Every whole text is encoded once; documents are counted by encoded length;
suffix sums over the lengths then answer, for every context limit, how many
documents are longer and what is left when all are cut to the limit, and the
share of documents that fit (exact quantiles).  The histogram has one row per
distinct length and is summed by ranges, never in one task.

Edge cases: null and empty texts have length 0; repeated rows count each;
an empty table gives an empty histogram; other columns are ignored unless
they are named as groups; a null group is a group of its own.
"""

from __future__ import annotations

import base64
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnprobe.llm.common import running_totals, store

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-splitting pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCABULARY_BYTES = 64 << 20
_LOADED: dict[tuple, object] = {}        # per Python worker


def _encoding(data: bytes, pattern: str):
    key = (len(data), zlib.crc32(data), pattern)
    if key not in _LOADED:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _LOADED[key] = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def vocabulary(spark: SparkSession, path: str = TOKENIZER):
    """The vocabulary file as a broadcast; its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is no vocabulary of at most {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def with_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN,
                 text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and n_tokens (long) of every row."""
    bc = vocabulary(docs.sparkSession, tokenizer)

    def run(batches):
        enc = _encoding(bc.value, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())],
                                             names=[*batch.schema.names[:-1], "n_tokens"])

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", "long")
    return rows.mapInArrow(run, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): one row per distinct length, map-side combined."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(hist: DataFrame) -> DataFrame:
    """Per distinct length L: n_docs, docs_longer, tokens_longer (of the
    documents longer than L), truncated_tokens (sum of min(length, L)),
    total_docs, total_tokens, cdf (share of documents of at most L tokens)."""
    hist = store(hist, "op3-histogram")
    total = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"),
                     F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("t")).first()
    rows = running_totals(hist.withColumn("_t", F.col("n_docs") * F.col("n_tokens")), [F.col("n_tokens").desc()],
                          {"docs_longer": "n_docs", "tokens_longer": "_t"}, "op3-suffix")
    kept = F.lit(total["t"]) - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return rows.select("n_tokens", "n_docs", "docs_longer", "tokens_longer", kept.cast("long").alias("truncated_tokens"),
                       F.lit(total["d"]).cast("long").alias("total_docs"), F.lit(total["t"]).cast("long").alias("total_tokens"),
                       ((F.lit(total["d"]) - F.col("docs_longer")) / F.lit(max(total["d"], 1)).cast("double")).alias("cdf"))


def at_limits(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """(context_limit, docs_longer, truncated_tokens) for any limits, from the
    rows of ``context_limits`` alone: the nearest length not above a limit
    has the same documents beyond it."""
    out = None
    for limit in wanted:
        near = F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "docs_longer", "truncated_tokens")))
        row = limits.agg(near.alias("r"), F.max("total_docs").alias("d")).select(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce("r.docs_longer", "d", F.lit(0)).alias("docs_longer"),
            (F.coalesce("r.truncated_tokens", F.lit(0))
             + F.coalesce("r.docs_longer", "d", F.lit(0)) * (limit - F.coalesce("r.n_tokens", F.lit(0)))).alias("truncated_tokens"))
        out = row if out is None else out.unionAll(row)
    return out


def quantiles(limits: DataFrame, probabilities: list[float]) -> DataFrame:
    """One row: the least length that covers each share of the documents."""
    return limits.agg(*[F.min(F.when(F.col("total_docs") - F.col("docs_longer") >= F.lit(p) * F.col("total_docs"),
                                     F.col("n_tokens"))).alias(f"q{p:g}") for p in probabilities])
