"""Quotation linking for chat formatting (operator 1), DataFrame functions only.

Quote levels are the ``>`` marks before a line.  A run of lines of one level
is a passage; passages and their lines are normalised (white space joined,
lower case) and hashed, and so are each message's own lines and own text.  A
quoted hash belongs to the first earlier message of the conversation that
holds it.  A message answers the original of its outermost linked quotes:
least level, then most quoted characters, then the latest message.  Roots
follow by pointer doubling; a conversation is ordered by thread (its root's
turn), then turn, so an answer always follows its original.  Texts come back
without quotes and without the "... wrote:" line before one.

One original per (conversation, hash) keeps the join linear, whatever is
quoted how often; positions come from ranges, so a conversation of any size
is never one task.

Edge cases: a null text counts as empty; messages with a null conversation
or turn are kept, link with nothing and come first in their order; repeated
(conversation, turn) rows share their links and stand side by side; blank
quotes link with nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nnprobe.llm.common import SPACE, once, running_totals, store

# Quote marks and the line that introduces a quote.
MARKS = "^(?:[ \\t]*>)+[ \\t]?"
WROTE = "(?i)(wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió)[ \\t]*:[ \\t\\r]*$"


def normalised(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, f"[{SPACE}]+", " ")))


def parse_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), quotes (passages as
    structs of level and lines)."""
    rows = messages.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    rows = once(rows, raw=F.split("text", "\n")).drop("text")
    rows = once(rows, ls=F.transform("raw", lambda x: F.struct(
        F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"),
        F.regexp_replace(x, MARKS, "").alias("body")))).drop("raw")
    at = F.sequence(F.lit(0), F.size("ls") - 1)
    rows = once(rows, starts=F.filter(at, lambda i: (i == 0) | (F.get("ls", i)["level"] != F.get("ls", i - 1)["level"])))
    until = lambda k: F.coalesce(F.get("starts", k + 1), F.size("ls"))
    rows = once(rows, runs=F.transform("starts", lambda s, k: F.struct(
        F.get("ls", s)["level"].alias("level"),
        F.slice(F.col("ls.body"), s + 1, until(k) - s).alias("lines")))).drop("starts")
    # the last own line before a quote introduces it
    kept = F.filter(F.transform("ls", lambda x, i: F.struct(
        x["body"].alias("body"),
        ((x["level"] == 0) & ~((F.coalesce(F.get("ls", i + 1)["level"], F.lit(0)) > 0) & x["body"].rlike(WROTE))).alias("own"))),
        lambda x: x["own"])
    own = F.array_join(F.transform(kept, lambda x: x["body"]), "\n")
    own = F.regexp_replace(own, f"^[{SPACE}]*\\n|[{SPACE}]+$", "")
    return once(rows, own=own, quotes=F.filter("runs", lambda r: r["level"] > 0)).drop("ls", "runs")


def _units(lines: Column) -> Column:
    """Normalised lines and the normalised whole, distinct and not blank."""
    every = F.concat(F.transform(lines, normalised), F.array(normalised(F.array_join(lines, " "))))
    return F.filter(F.array_distinct(every), lambda x: x != "")


def link_quotes(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_linked) of the messages with linked quotes, stored."""
    known = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    said = (known.select("conv_id", "turn", F.explode(_units(F.split("own", "\n"))).alias("u"))
            .groupBy("conv_id", F.xxhash64("u").alias("h")).agg(F.min("turn").alias("origin")))
    quoted = (known.select("conv_id", "turn", F.explode("quotes").alias("q"))
              .select("conv_id", "turn", F.col("q.level").alias("level"), F.explode(_units(F.col("q.lines"))).alias("u"))
              .groupBy("conv_id", "turn", "level", F.xxhash64("u").alias("h")).agg(F.max(F.length("u")).alias("chars")))
    votes = (quoted.join(said, ["conv_id", "h"]).where(F.col("origin") < F.col("turn"))
             .groupBy("conv_id", "turn", "level", "origin").agg(F.sum("chars").alias("chars"), F.count("*").alias("n")))
    best = F.min(F.struct("level", (-F.col("chars")).alias("chars"), (-F.col("origin")).alias("origin")))
    return store(votes.groupBy("conv_id", "turn").agg(best.alias("b"), F.sum("n").alias("n_linked"))
                 .select("conv_id", "turn", (-F.col("b.origin")).alias("parent"), "n_linked"), "op1-links")


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) by pointer doubling: log2(depth) joins."""
    cur = links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = cur.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        nxt = store(cur.join(up, ["conv_id", "root"], "left").select(
            "conv_id", "turn", F.coalesce("up", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")), "op1-roots")
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        cur = nxt.drop("moved")


def link_conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, position (0-based, in reply order), turn,
    role, parent_turn, root_turn, depth, n_quotes, max_level, n_linked, text."""
    parsed = store(parse_quotes(messages).withColumn("rid", F.monotonically_increasing_id()), "op1-parsed")
    links = link_quotes(parsed)
    tied = links.join(thread_roots(links), ["conv_id", "turn"])
    # the order is found on narrow rows; texts move once, to their place in it
    rows = (parsed.select("rid", "conv_id", "turn", F.xxhash64("role", "own").alias("h")).join(tied, ["conv_id", "turn"], "left")
            .select("rid", "conv_id", "turn", "h", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
                    F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")))
    placed = store(running_totals(rows, ["conv_id", "root_turn", "turn", "h", "rid"], {}, "op1-order"), "op1-placed")
    first = placed.groupBy(F.col("conv_id").alias("_c")).agg(F.min("_pos").alias("_p0"))
    at = (placed.join(first, F.col("conv_id").eqNullSafe(F.col("_c")))
          .select("rid", (F.col("_pos") - F.col("_p0")).alias("position"), "parent_turn", "root_turn", "depth", "n_linked"))
    return parsed.join(at, "rid").select(
        "conv_id", "position", "turn", "role", "parent_turn", "root_turn", "depth", F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.col("quotes.level")), F.lit(0)).cast("long").alias("max_level"), "n_linked", F.col("own").alias("text"))
