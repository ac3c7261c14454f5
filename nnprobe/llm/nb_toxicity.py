"""Toxicity by a character n-gram linear classifier with naive Bayes scaled
features (operator 8).

A document's features are the distinct character n-grams (4 to 8 code points,
lower case, runs of white space as one blank) hashed to 2**20 places.  Over
all labelled training rows Spark counts in how many documents of each class a
place occurs; the log-count ratio of the smoothed class shares scales the
feature.  Every place that occurs has a weight: the
places that separate the classes best have a coefficient of their own, the
others one for all of about the same ratio, whose ratios a document sums up
(for the fit by the counts of the other rows).  They feed a logistic
regression with an L2 penalty, fitted on a bounded sample of the training rows
(``sample_rows``, by hash of the id, up to half of them of each class, the
intercept corrected by the class totals); everything else covers all rows.
Every whole text is then scored; a text is read in pieces, so its length is
no matter.

Edge cases: null and empty texts have no features and get the bias alone;
labels that are null, or whose doc_id is null or not in the table, teach
nothing; several labels of one document count as toxic if one is; without two
classes the score is the smoothed share of the one class (0.5 without any);
a null doc_id is never held out; other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nnprobe.llm.common import store

SIZES = (4, 5, 6, 7, 8)
BITS = 20
FEATURES = 4096                       # places with a coefficient of their own; the others share one a group
GROUPS = np.arange(-4.0, 5.0)         # edges of their log-count ratios
SAMPLE_ROWS = 20_000
FIT_ROWS = 1024                       # of the sample, worked on at once
LABEL_BROADCAST_ROWS = 500_000        # 16 bytes each; more labels are joined by shuffle
PIECE = 1 << 18                       # code points hashed at once
_BLANK = re.compile(r"\s+")


def _places(text: str):
    """Hashed n-grams, an array a piece; pieces overlap by the longest n-gram."""
    text = _BLANK.sub(" ", f" {text.lower()} ")
    step = PIECE - max(SIZES) + 1
    for lo in range(0, max(len(text) - max(SIZES) + 1, 1), step):
        c = np.frombuffer(text[lo:lo + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        h, found = np.zeros(len(c), np.uint32), []
        for n in range(1, max(SIZES) + 1):
            if len(c) < n:
                break
            h = (h[:len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1:] * np.uint32(0x9E3779B1))
            if n in SIZES:
                x = h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
                found.append(x >> np.uint32(32 - BITS))
        if found:
            yield np.concatenate(found)


def held_out(id_col: str = "doc_id"):
    """True for the rows that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows outside the held-out fold, stored."""
    y = (labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
         .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
         .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    y = y.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    if y.count() <= LABEL_BROADCAST_ROWS:
        y = F.broadcast(y)
    return store(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(y, "doc_id"), "op8-train")


def _count_batches(batches):
    counts = np.zeros((2, 1 << BITS), np.int32)
    slot = np.zeros(1 << BITS, np.int32)
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[y, _distinct(text, slot)] += 1
    at = np.flatnonzero(counts.any(axis=0))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])],
                                         names=["place", "n0", "n1"])


@dataclass
class ToxicModel:
    """Places, their weights (log-count ratio times coefficient) and the bias."""
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        t = np.zeros(1 << BITS, np.int32)
        t[self.places] = np.arange(1, len(self.places) + 1)
        return t


def _distinct(text: str | None, slot: np.ndarray | None = None) -> np.ndarray:
    """Distinct places of a text, each where it stands last; ``slot`` is
    scratch of 2**BITS int32, whose content does not matter."""
    slot = np.zeros(1 << BITS, np.int32) if slot is None else slot
    at = np.zeros(0, np.uint32)
    for x in _places(text or ""):
        at = np.concatenate([at, x]) if len(at) else x       # at most 2**BITS places of the pieces before
        i = np.arange(len(at), dtype=np.int32)
        slot[at] = i
        at = at[slot[at] == i]
    return at


def _present(text: str | None, table: np.ndarray, slot: np.ndarray | None = None) -> np.ndarray:
    t = table[_distinct(text, slot)]
    return t[t > 0] - 1


def _shared_ratio(c0, c1, n0: int, n1: int):
    """Log-count ratio smoothed by one row dealt as the classes are."""
    share = n1 / (n0 + n1)
    return np.log((c1 + share) / (c0 + 1 - share)) - np.log(n1 / n0)


def _fit(rows: list[np.ndarray], sums: np.ndarray, y: np.ndarray, ratio: np.ndarray, l2: float = 1.0,
         steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features by accelerated gradient
    descent (mean log loss + l2 / (2 rows) * |w|^2), from zero: the same rows
    in the same order give the same model.  ``rows`` holds each row's places
    in the feature list, ``sums`` a column for each group of the other places;
    the weights of the groups follow those of the features."""
    n, width = len(rows), len(ratio)
    parts = [slice(i, i + FIT_ROWS) for i in range(0, n, FIT_ROWS)]          # bounds what a step holds besides the rows
    at = [np.concatenate(rows[p]) for p in parts]
    sizes = np.array([len(r) for r in rows], np.int64)
    starts = [np.concatenate([[0], np.cumsum(sizes[p])]) for p in parts]

    def forward(v):
        scaled = v[:width] * ratio
        return np.concatenate([np.diff(np.concatenate([[0.0], np.cumsum(scaled[a])])[e])
                               for a, e in zip(at, starts, strict=True)]) + sums @ v[width:]

    def backward(g):
        got = sum(np.bincount(a, weights=np.repeat(g[p], sizes[p]), minlength=width) for a, p in zip(at, parts, strict=True))
        return np.concatenate([got * ratio, g @ sums])

    v = np.ones(width + sums.shape[1])
    for _ in range(20):                                     # largest curvature by power iteration
        v = backward(forward(v))
        v /= max(float(np.linalg.norm(v)), 1e-12)
    rate = 1.0 / (0.25 * (float(np.linalg.norm(forward(v))) ** 2 / n + 1) + l2 / n)
    w, look, bias, bias_look = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    for k in range(steps):
        g = 1 / (1 + np.exp(-np.clip(forward(look) + bias_look, -30, 30))) - y
        w2 = look - rate * (backward(g) / n + l2 / n * look)
        b2 = bias_look - rate * float(g.mean())
        m = k / (k + 3)
        look, bias_look = w2 + m * (w2 - w), b2 + m * (b2 - bias)
        w, bias = w2, b2
    return w, bias


def _sample(rows: DataFrame, n0: int, n1: int, sample_rows: int) -> DataFrame:
    """(text, toxic) of about ``sample_rows`` rows by hash of the id, half of
    them of each class; what a class lacks the other one fills.  No class that
    has rows is left out."""
    half = max(1, sample_rows // 2)
    kept = None
    for y, n, other in ((0, n0, n1), (1, n1, n0)):
        of_class = rows.where(F.col("toxic") == y)
        want = max(half, sample_rows - other)
        if n > want:
            place = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 40))
            part = of_class.where(place < int(want / n * (1 << 40)))
            # few ids under many rows may all lie outside the share
            of_class = of_class.orderBy(place, "text").limit(want) if part.isEmpty() else part
        of_class = of_class.select("text", "toxic")
        kept = of_class if kept is None else kept.unionAll(of_class)
    return kept


def train(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    rows = training_rows(docs, labels)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}    # two rows
    n0, n1 = n.get(0, 0), n.get(1, 0)
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    none = ToxicModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not n0 or not n1:
        return none
    # at most 2**BITS places come to the driver, whatever the input
    p0, p1 = (F.col("n0") + 1) / (n0 + 2), (F.col("n1") + 1) / (n1 + 2)
    p = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    counts = (rows.select("text", "toxic").mapInArrow(_count_batches, "place int, n0 int, n1 int")
              .groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
              .select("place", F.col("n0").cast("float"), F.col("n1").cast("float"),       # exact up to 2**24 documents
                      ((p1 - p0) * (p1 - p0) / (p * (1 - p))).cast("float").alias("gain")).toArrow())
    place, c0, c1, gain = (counts.column(c).to_numpy() for c in ("place", "n0", "n1", "gain"))
    order = np.lexsort((place, -gain))
    place, c0, c1 = place[order], c0[order], c1[order]
    del counts, gain, order
    ratio = np.log(((c1[:features] + 1.0) / (n1 + 2)) / ((c0[:features] + 1.0) / (n0 + 2)))
    bc = docs.sparkSession.sparkContext.broadcast((ToxicModel(place, ratio, 0.0).table(), c0, c1))

    def present(batches):
        table, c0, c1 = bc.value
        slot = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            out, sums = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                at = _present(text, table, slot)
                out.append(np.sort(at[at < features]).tobytes())
                # the other places as the other rows know them: with its own label in the counts a row looks too easy
                at = at[at >= features]
                at = at[c0[at] + c1[at] > 1]
                x = _shared_ratio(c0[at] - np.float64(1 - y), c1[at] - np.float64(y), max(n0 - (1 - y), 1), max(n1 - y, 1))
                sums.append(np.bincount(np.digitize(x, GROUPS), weights=x, minlength=len(GROUPS) + 1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(sums, pa.binary()), batch.column("toxic")],
                                             names=["x", "sums", "toxic"])

    got = _sample(rows, n0, n1, sample_rows).mapInArrow(present, "x binary, sums binary, toxic int").toArrow()
    bc.destroy()
    drawn = sorted(zip(*(got.column(c).to_pylist() for c in ("toxic", "x", "sums")), strict=True))   # one order, one model
    m1 = sum(y for y, _, _ in drawn)
    sums = np.array([np.frombuffer(x) for _, _, x in drawn])
    scale = np.sqrt((sums * sums).mean(axis=0))
    scale[scale == 0] = 1.0
    w, bias = _fit([np.frombuffer(x, np.int32) for _, x, _ in drawn], sums / scale, np.array([float(y) for y, _, _ in drawn]), ratio)
    # the sample's odds of the classes give way to those of all rows
    bias += float(np.log(n1 / n0) - np.log(m1 / (len(drawn) - m1)))
    weights = np.empty(len(place), np.float32)
    weights[:len(ratio)] = w[:len(ratio)] * ratio
    for lo in range(len(ratio), len(place), 1 << 16):
        other = _shared_ratio(c0[lo:lo + (1 << 16)].astype(float), c1[lo:lo + (1 << 16)].astype(float), n0, n1)
        weights[lo:lo + (1 << 16)] = (w[len(ratio):] / scale)[np.digitize(other, GROUPS)] * other
    return ToxicModel(place, weights, bias)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, the probability of label 1 (an equal-named column is replaced)."""
    by_place = np.zeros(1 << BITS, np.float32)
    by_place[model.places] = model.weights
    bc = docs.sparkSession.sparkContext.broadcast((by_place, model.bias))
    docs = docs.drop(out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    at, names = docs.columns.index(text_col), schema.names

    def run(batches):
        weights, bias = bc.value
        slot = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            s = [bias + float(weights[_distinct(t, slot)].sum(dtype=np.float64)) for t in batch.column(at).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(s, np.float64), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)
