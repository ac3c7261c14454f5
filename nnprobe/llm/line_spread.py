"""Line dedup by the spread of a line over sites (operator 5).

Lines are compared after trimming, joining white space and lower-casing.  A
line that stands on ``min_sites`` distinct sites or more is cross-site
boilerplate: its first occurrence (least doc_id, then line number) stays, all
others are removed.  HyperLogLog sketches of the sites, one per line hash,
merge map-side and across tasks (fixed registers in the hash aggregate, which
spills); lines whose estimate lies within four standard errors and two sites of
the threshold get an exact distinct count instead.

A line is known by a 64-bit hash.  Every line with a word is judged, however
short (``min_words`` asks for more).  Lines that all come from one site skip
the sketch.  Lines meet a table of hashes by broadcast while it is small, else
dealt by hash and document, so a line that a third of all rows hold is no one
task's work.

Edge cases: a null text stays null and has no lines; a null source counts as
one site; rows with a null doc_id count for the spread but keep their text;
repeated rows lose the same lines, rows with one doc_id and different texts each
their own (the first occurrence is the least line number, then the least hash of
the text); a first occurrence repeated inside one
document stays once; other columns are carried unchanged (working columns
start with ``_ls_``).  Kept lines keep their exact text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nnprobe.llm.common import SPACE, once, store

MIN_SITES = 5
MIN_WORDS = 1
ERROR = 0.05           # standard error of a sketch (512 registers)
LINE_BROADCAST_ROWS = 500_000         # hashes shipped whole, 16 bytes each
SALTS = 16             # tasks that share the occurrences of one line beyond that


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " ")))


def hashed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, site, t, at, h) of the lines long enough to judge; t tells the texts of one doc_id apart."""
    site = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    # normalised inside the array, so that each line is worked on once
    rows = docs.select("doc_id", site.alias("site"), F.xxhash64("text").alias("t"), F.posexplode(F.transform(F.split("text", "\n"), normalised)).alias("at", "line"))
    blanks = F.length("line") - F.length(F.replace("line", F.lit(" ")))
    return rows.where((F.length("line") > 0) & (blanks >= min_words - 1)).select(
        "doc_id", "site", "t", "at", F.xxhash64("line").alias("h"))


def _meet(lines: DataFrame, few: DataFrame) -> DataFrame:
    """``lines`` with the columns of their hash's row in the stored table ``few``; no other line stays."""
    if few.count() <= LINE_BROADCAST_ROWS:
        return lines.join(F.broadcast(few), "h")
    salt = F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS))
    every = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return lines.withColumn("_salt", salt).join(every, ["h", "_salt"]).drop("_salt")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, error: float = ERROR) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` distinct sites, stored:
    (h, doc0) with the least doc_id they stand in."""
    several = (lines.groupBy("h").agg(F.min("site").alias("a"), F.max("site").alias("b"))
               .where((F.col("a") < F.col("b")) if min_sites > 1 else F.lit(True)).select("h"))
    shared = _meet(lines.select("h", "site", "doc_id", "at"), store(several, "op5-several"))
    found = store(shared.groupBy("h").agg(F.approx_count_distinct("site", error).alias("est"),
                                          F.min("doc_id").alias("doc0")), "op5-estimates")
    near = F.abs(F.col("est") - min_sites) <= max(2.0, 4 * error * min_sites)
    exact = (_meet(lines.select("h", "site", "doc_id", "at"), store(found.where(near).select("h"), "op5-near"))
             .select("h", "site").distinct()
             .groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h"))
    sure = found.where(~near & (F.col("est") >= min_sites)).select("h", "doc0")
    return store(sure.unionAll(found.join(exact, "h").select("h", "doc0")), "op5-spread")


def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``_ls_text`` (text without the removed lines),
    ``_ls_lines`` and ``_ls_removed``."""
    lines = store(hashed_lines(docs.select("doc_id", "source", "text"), min_words), "op5-lines")
    wide = spread_lines(lines, min_sites)
    hit = _meet(lines.where(F.col("doc_id").isNotNull()), wide).select("doc_id", "doc0", "h", "t", "at")
    here = F.min(F.struct("at", "t")).over(Window.partitionBy("doc_id", "h"))        # one line within one document
    again = hit.where(F.col("doc_id") == F.col("doc0")).withColumn("first", here).where(F.struct("at", "t") > F.col("first"))
    gone = (hit.where(F.col("doc_id") != F.col("doc0")).select("doc_id", "t", "at").unionAll(again.select("doc_id", "t", "at"))
            .distinct().groupBy("doc_id", "t").agg(F.collect_list("at").alias("_ls_gone"))      # at most the document's lines
            .withColumnsRenamed({"doc_id": "_ls_doc", "t": "_ls_t"}))
    out = docs.join(gone, (F.col("doc_id") == F.col("_ls_doc")) & (F.xxhash64("text") == F.col("_ls_t")), "left").drop("_ls_doc", "_ls_t")
    out = once(out, _ls_all=F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_ls_all") - 1), F.col("_ls_gone"))
    text = F.array_join(F.transform(left, lambda i: F.get(F.col("_ls_all"), i)), "\n")
    return out.withColumns({"_ls_text": F.when(F.col("_ls_gone").isNull(), F.col("text")).otherwise(text),
                            "_ls_lines": F.coalesce(F.size("_ls_all"), F.lit(0)).cast("long"),
                            "_ls_removed": F.coalesce(F.size("_ls_gone"), F.lit(0)).cast("long")}).drop("_ls_gone", "_ls_all")
