"""Line-first quality cleaning (operator 10), DataFrame functions only.

Every line is judged first (punctuation, navigation, boilerplate, symbol and
capital rules); failing lines go; a document that loses more than
``max_lost`` of its word characters is rejected.  The base metrics of the
whole text are computed beside it: repeated 8-word windows are found by
hashing the windows of a text and sorting the hashes only where a hash occurs
twice, all inside the row, so nothing is shuffled.

Edge cases: a null text counts as empty (no words, base_failed); blank lines
are neither judged nor counted; rows repeat unchanged; other columns are
carried by ``clean_lines`` under their own names (working columns start with
``_lf_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nnprobe.llm.common import SPACE, once

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MAX_LOST = 0.6

# The rules for one line.
LINE_END = "[.!?…:;。！？।॥؟۔؛፧።։។][\"'”’»)\\]*]*[\\x20\\x09-\\x0D]*$"
INNER_END = "[.!?…。！？।॥؟۔፧።։។][\"'”’»)\\]]*[\\x20\\x09-\\x0D]"
TAIL = 40             # characters looked at first; the rest counts where these are all of AFTER_END
AFTER_END = "^[\"'”’»)\\]*\\x20\\x09-\\x0D\\x85\\u2028\\u2029]*$"
LONG_LINE = 200       # a line this long with a sentence end inside passes without one at its end
NOTICE_SHARE = 20     # boilerplate phrases count where they are one part in so many of the line, or more
NAV_BARS = "([|>»·•/][^|>»·•/]*){3,}"
NAV_WORDS = ("(?i)^[\\x20\\x09-\\x0D]*(home|menu|next|previous|prev|back|login|log in|sign in|sign up|register|search|"
             "share|read more|click here|skip to content|contact us|about us)\\b.{0,40}$")
BOILERPLATE = ("(?i)(all rights reserved|privacy policy|cookie policy|accept (all )?cookies|uses cookies|"
               "terms of (use|service)|enable javascript|subscribe to our|newsletter|copyright ©|lorem ipsum|"
               "licensed under|released under the|is free software|permission is hereby granted|"
               "alle rechte vorbehalten|datenschutzerkl[äÄ]rung|verwendet cookies|cookies akzeptieren|nutzungsbedingungen|"
               "tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|utilise des cookies|accepter les cookies|"
               "conditions d['’]utilisation|mentions l[éÉ]gales|todos los derechos reservados|pol[íÍ]tica de privacidad|"
               "utiliza cookies|aceptar (las )?cookies|condiciones de uso|aviso legal)")
# Each phrase above holds one of these in lower case: the regular expression is slow and tried only where one stands.
BOILERPLATE_SIGNS = ("rights reserved", "privacy policy", "cookie", "terms of ", "enable javascript", "subscribe to our",
                     "newsletter", "copyright ©", "lorem ipsum", "licensed under", "released under the", "is free software",
                     "permission is hereby granted", "rechte vorbehalten", "datenschutzerkl", "nutzungsbedingungen",
                     "tous droits r", "politique de confidentialit", "utilisation", "mentions l", "todos los derechos",
                     "tica de privacidad", "condiciones de uso", "aviso legal")
SYMBOL = "[#*$%&|<>]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOL[1:-1]}]+", ""))


def _ends(line: Column) -> Column:
    """``line.rlike(LINE_END)``, from the line's end: only what may follow the end's mark can hide it from the tail."""
    tail = F.substring(line, -TAIL, TAIL)
    return tail.rlike(LINE_END) | (tail.rlike(AFTER_END) & line.rlike(LINE_END))


def _has_sign(line: Column) -> Column:
    """False only for lines without a boilerplate phrase."""
    def any_of(low):
        found = low.contains(BOILERPLATE_SIGNS[0])
        for sign in BOILERPLATE_SIGNS[1:]:
            found = found | low.contains(sign)
        return found
    return F.exists(F.array(F.lower(line)), any_of)          # the lower-case line is built once


def line_fails(line: Column) -> Column:
    """True for a line that a rule removes; blank lines pass."""
    letters = F.length(F.regexp_replace(line, "\\P{L}+", ""))
    capitals = F.length(F.regexp_replace(line, "\\P{Lu}+", ""))
    prose = _ends(line) | ((F.length(line) >= LONG_LINE) & line.rlike(INNER_END))
    bad = (~prose
           | (line.rlike(NAV_BARS) & (F.length(F.regexp_replace(line, "[^|>»·•/]+", "")) * 20 > F.length(line)))
           | line.rlike(NAV_WORDS) | (_has_sign(line) & line.rlike(BOILERPLATE) & (
               (F.length(line) - F.length(F.regexp_replace(line, BOILERPLATE, ""))) * NOTICE_SHARE >= F.length(line)))
           | (_symbols(line) * 10 > F.length(line))
           # over 0.7 of 20 letters or more are at least 15 capitals: most lines have fewer, and their letters go uncounted
           | ((capitals >= 15) & (letters >= 20) & (capitals * 10 > letters * 7)))
    return line.rlike(f"[^{SPACE}]") & bad


def base_metrics(df: DataFrame, text_col: str) -> DataFrame:
    """Adds _lf_n, _lf_chars, _lf_symbols, _lf_dups, _lf_repeat."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = once(df, _lf_words=_words(text),
               _lf_real=F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    a = once(a, _lf_n=F.size("_lf_words").cast("long"),
               _lf_chars=F.length(F.concat_ws("", "_lf_words")).cast("long"),
               _lf_symbols=_symbols(text).cast("long"),
               _lf_dups=(F.size("_lf_real") - F.size(F.array_distinct("_lf_real"))).cast("long"),
               _lf_wh=F.transform("_lf_words", lambda w: F.xxhash64(w))).drop("_lf_words", "_lf_real")
    k = WINDOW
    a = once(a, _lf_win=F.when(F.size("_lf_wh") >= k, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_lf_wh") - (k - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice("_lf_wh", i, k)))).otherwise(F.array().cast("array<bigint>"))).drop("_lf_wh")
    twice = F.size(F.array_distinct("_lf_win")) < F.size("_lf_win")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    a = once(a, _lf_sorted=F.when(twice, F.sort_array(F.transform(
        "_lf_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("_lf_win")
    s, m = F.col("_lf_sorted"), F.size("_lf_sorted")
    marked = F.transform(s, lambda x, i: F.struct(
        x["i"].alias("i"),
        ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]) | (i < m - 1) & (F.get(s, i + 1)["h"] == x["h"])).alias("r")))
    a = once(a, _lf_at=F.sort_array(F.transform(F.filter(marked, lambda x: x["r"]), lambda x: x["i"]))).drop("_lf_sorted")
    p, q = F.col("_lf_at"), F.size("_lf_at")
    cover = F.transform(p, lambda x, i: F.when(i == q - 1, F.lit(k)).otherwise(F.least(F.lit(k), F.get(p, i + 1) - x)))
    return once(a, _lf_repeat=F.aggregate(cover, F.lit(0), lambda t, x: t + x).cast("long")).drop("_lf_at")


def clean_lines(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with the cleaned text in ``_lf_text`` and the verdict columns
    ``_lf_lost`` (share of word characters lost) and ``_lf_kept``."""
    a = base_metrics(docs, text_col)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    a = once(a, _lf_text=F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n"))
    left = F.length(F.regexp_replace("_lf_text", f"[{SPACE}]+", ""))
    a = a.withColumn("_lf_lost", F.when(F.col("_lf_chars") > 0, 1 - left / F.col("_lf_chars")).otherwise(F.lit(0.0)))
    failed = (F.col("_lf_n") < MIN_WORDS) | (100 * F.col("_lf_repeat") > MAX_REPEAT_PCT * F.col("_lf_n"))
    return a.withColumn("_lf_base_failed", failed).withColumn(
        "_lf_kept", ~failed & (F.col("_lf_lost") <= max_lost))
