"""Near-duplicate documents by circulant MinHash (operator 2).

A document's distinct 5-word shingles are hashed to 64 bits.  Permutation
sigma sends a shingle hash to a place in a ring of 2**32, permutation pi
ranks places, and signature coordinate k is the least pi(place + k): one
second permutation, circularly shifted, gives all coordinates.  Bands of
coordinates meet in buckets.

Copies with the same set are one class before banding.  Inside a bucket
nothing is paired with everything: each round compares the bucket's members
with one pivot, drops the pivot and the buckets whose members already lie in
one component.  The links still missing between components are found by an
exact prefix filter over the members left.  A pair is linked only after its
full sets were intersected; a sketch of one byte per coordinate only discards
pairs estimated far below the threshold (four deviations).

Edge cases: null and word-free texts have an empty set and link with nothing;
1-4 words form one shingle; repeated rows and rows sharing a doc_id are
copies of one document; a null doc_id keeps its row (component null, kept
true).  Very long texts are hashed piece by piece.  Columns beside the id and
text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnprobe.llm.common import components, drop_stored, store
from nnprobe.llm.wordhash import mix, word_hashes

WORDS = 5
THRESHOLD_PCT = 85
MISS = 1e-4                # probability that the bands miss a pair at the threshold
COORDINATES = 192          # at most, unless one row a band needs more
PIVOT_ROUNDS = 2
_BLOCK = 1 << 16           # shingles per numpy block
_C1, _C2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)      # public murmur3 constants
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9,
                                0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

SIG_SCHEMA = "doc_id long, n long, f1 long, f2 long, bands array<long>, sk binary"
SET_SCHEMA = "rep long, n long, sk binary, shingles array<long>"


def banding(threshold_pct: int) -> tuple[int, int, float]:
    """(bands, rows, sketch cut): as many rows a band as the coordinates allow
    at ``MISS``; the cut lies four deviations below the threshold.  At 85: 24
    bands of 7, cut 0.74."""
    t = threshold_pct / 100
    if not 0 < t <= 1:
        raise ValueError("threshold_pct must lie in 1..100")
    need = lambda rows: 1 if t == 1 else math.ceil(math.log(MISS) / math.log1p(-t ** rows))
    rows = max((k for k in range(2, COORDINATES + 1) if t ** k > 0.01 and k * need(k) <= COORDINATES), default=1)
    bands = need(rows)
    return bands, rows, t - 4 * math.sqrt(t * (1 - t) / (bands * rows))


BANDS, ROWS, _ = banding(THRESHOLD_PCT)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after another, set sizes)."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    k = WORDS
    rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled += mix(words[j:len(words) - k + 1 + j] + _MULT[j]) if len(rolled) else rolled
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if not n:
            continue
        if n >= k:
            got = np.unique(rolled[end - n:end - k + 1])
        else:
            seq = np.array([n], np.uint64)
            for w in words[end - n:end]:
                seq = mix(seq * _MULT[1] + w)
            got = seq
        out.append(got)
        sizes[i] = len(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def signatures(flat: np.ndarray, sizes: np.ndarray, kinds: int = BANDS * ROWS) -> np.ndarray:
    """(texts with a set, kinds) uint32: least pi(sigma(shingle) + k)."""
    own = sizes[sizes > 0]
    sig = np.full((len(own), kinds), np.uint32(0xFFFFFFFF), np.uint32)
    place = (mix(flat) >> np.uint64(32)).astype(np.uint32) * _C1
    bounds = np.concatenate([[0], np.cumsum(own)])
    for lo in range(0, len(place), _BLOCK):
        hi = min(lo + _BLOCK, len(place))
        first = int(np.searchsorted(bounds, lo, "right") - 1)
        last = int(np.searchsorted(bounds, hi, "left"))
        cuts = np.maximum(bounds[first:last], lo) - lo
        part = place[lo:hi]
        x, y = np.empty_like(part), np.empty_like(part)
        for k in range(kinds):
            np.add(part, np.uint32((k + 1) * int(_C1) & 0xFFFFFFFF), out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _C2, out=x)
            np.right_shift(x, np.uint32(13), out=y)
            np.bitwise_xor(x, y, out=x)
            np.minimum(sig[first:last, k], np.minimum.reduceat(x, cuts), out=sig[first:last, k])
    return sig


def _band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * _MULT[0] + sig[:, b * rows + r])
        out[:, b] = h
    return out


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _slices(batch: pa.RecordBatch, col: str, most: int = 4 << 20):
    """Parts of a batch with about ``most`` bytes of text."""
    texts = batch.column(col).to_pylist()
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most or i == len(texts) - 1:
            yield lo, i + 1, texts[lo:i + 1]
            lo, held = i + 1, 0


def _signature_batches(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for lo, hi, texts in _slices(batch, "text"):
                flat, sizes = shingle_sets(texts)
                sig = signatures(flat, sizes, bands * rows)
                has = np.flatnonzero(sizes)
                f1, f2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
                if len(has):
                    cuts = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
                    f1[has] = np.add.reduceat(mix(flat + _MULT[2]), cuts)
                    f2[has] = np.add.reduceat(mix(flat ^ _MULT[3]), cuts)
                per = np.where(sizes > 0, bands, 0)
                low = np.ascontiguousarray(sig.astype(np.uint8))
                sk = [b""] * len(texts)
                for at, i in enumerate(has.tolist()):
                    sk[i] = low[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes), pa.array(f1.view(np.int64)),
                     pa.array(f2.view(np.int64)), _lists(_band_hashes(sig, bands, rows).reshape(-1), per), pa.array(sk, pa.binary())],
                    names=["doc_id", "n", "f1", "f2", "bands", "sk"])
    return run


def _set_batches(batches):
    for batch in batches:
        for lo, hi, texts in _slices(batch, "text"):
            flat, sizes = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").slice(lo, hi - lo), pa.array(sizes), batch.column("sk").slice(lo, hi - lo),
                 _lists(flat, sizes)], names=["rep", "n", "sk", "shingles"])


def _near_sketches(threshold: int):
    """Pairs whose sketches agree on enough coordinates; one byte agrees by
    chance once in 256."""
    bands, rows, cut = banding(threshold)

    def run(batches):
        least = (cut + (1 - cut) / 256) * bands * rows
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for c in ("sk_a", "sk_b"))
            keep = np.flatnonzero((a == b).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).take(pa.array(keep))
    return run


def _exact_pairs(threshold: int):
    def run(batches):
        for batch in batches:
            keep = []
            sets = []
            for c in ("set_a", "set_b"):
                col = batch.column(c)
                sets.append((col.offsets.to_numpy(), col.values.to_numpy()))
            (ao, av), (bo, bv) = sets
            for i in range(batch.num_rows):
                x, y = av[ao[i]:ao[i + 1]], bv[bo[i]:bo[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= threshold * (len(x) + len(y) - both) and both:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return run


def _side(sets: DataFrame, x: str, *cols: str) -> DataFrame:
    return sets.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])


def _near_pairs(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of (a, b), the pairs whose sizes and sketches allow the threshold, stored."""
    near = (pairs.join(_side(sets, "a", "n", "sk"), "a").join(_side(sets, "b", "n", "sk"), "b")
            .where((100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
            .select("a", "b", "sk_a", "sk_b").mapInArrow(_near_sketches(threshold), "a long, b long"))
    return store(near, "op2-near")


def _links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of (a, b), the pairs whose full sets reach the threshold, stored."""
    full = (pairs.join(_side(sets, "a", "shingles"), "a").join(_side(sets, "b", "shingles"), "b")
            .select("a", "b", F.col("shingles_a").alias("set_a"), F.col("shingles_b").alias("set_b"))
            .mapInArrow(_exact_pairs(threshold), "a long, b long"))
    return store(full, "op2-links")


def _open_buckets(act: DataFrame, turn: int) -> DataFrame:
    """Buckets with members in different components, each with a pivot: the
    member with the most links so far, which stands nearest to the others."""
    pick = F.min(F.struct((-F.col("degree")).alias("d"), F.xxhash64(F.col("rep"), F.lit(turn)).alias("h"), "rep", "label"))
    return store(act.groupBy("bucket").agg(pick.alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .where(F.col("lo") < F.col("hi"))
                 .select("bucket", F.col("p.rep").alias("pivot"), F.col("p.label").alias("pivot_label")), "op2-open")


def _prefix_pairs(act: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """All pairs of open members in different components that can reach the
    threshold, by an exact prefix filter.

    Shingles are ordered rarest first among the open members.  Sets of sizes
    n and m need t = threshold / (100 + threshold) * (n + m) common shingles,
    so their first common one, at places i and j of that order, leaves
    n - i >= t and m - j >= t.  Under one shingle only members outside its
    largest component are paired, never that component with itself."""
    member = act.select("rep", "label").distinct()
    flat = sets.join(member, "rep").select("rep", "label", "n", F.explode("shingles").alias("s"))
    freq = flat.groupBy("s").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    # a shingle of one member's own cannot be common: it only moves the places
    ranked = (flat.join(freq, "s").groupBy("rep", "label", "n")
              .agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("order"))      # one set
              .withColumn("own", F.col("n") - F.size("order")))
    room = F.floor(F.col("n") * (100 - threshold) / 100) + 1 - F.col("own")
    prefix = store(ranked.where(room > 0).select(
        "rep", "label", "n", "own", F.posexplode(F.slice("order", F.lit(1), room.cast("int"))).alias("at", "e"))
        .select("rep", "label", "n", "own", (F.col("own") + F.col("at")).alias("at"), F.col("e.s").alias("s")), "op2-prefix")
    top = (prefix.groupBy("s", "label").agg(F.count("*").alias("m")).groupBy("s")
           .agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("c")).where(F.col("c") > 1)
           .select("s", F.col("top.label").alias("top")))
    x = prefix.join(top, "s").alias("x")
    y = prefix.join(top, "s").where(F.col("label") != F.col("top")).alias("y")
    need = threshold * (F.col("x.n") + F.col("y.n"))
    met = (y.join(x, (F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label"))
                  & ((F.col("x.label") == F.col("x.top")) | (F.col("x.rep") < F.col("y.rep")))
                  & ((100 + threshold) * (F.col("x.n") - F.col("x.at")) >= need)
                  & ((100 + threshold) * (F.col("y.n") - F.col("y.at")) >= need))
           .select(F.col("x.rep").alias("p"), F.col("y.rep").alias("q"), F.col("x.n").alias("n"), F.col("y.n").alias("m"),
                   F.col("x.at").alias("i"), F.col("y.at").alias("j")))
    # up to the last common place i of one and j of the other all but c shingles are on one side only
    seen = met.groupBy("p", "q", "n", "m").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    only_p, only_q = F.col("i") + 1 - F.col("c"), F.col("j") + 1 - F.col("c")
    both = F.least(F.col("n") - only_p, F.col("m") - only_q)
    return (seen.where(100 * both >= threshold * (both + only_p + only_q))
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = store(base.mapInArrow(_signature_batches(*banding(threshold_pct)[:2]), SIG_SCHEMA), "op2-sig")
    # copies with one set: one class, led by its smallest id
    reps = store(sig.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("n", "f1", "f2")
                 .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sk").alias("sk")),
                 "op2-reps")
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = (buckets.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
              .where(F.col("lo") < F.col("hi")).select("bucket"))
    act = store(buckets.join(shared, "bucket").withColumns({"label": F.col("rep"), "degree": F.lit(0).cast("long")}),
                "op2-members")
    cand = reps.join(act.select("rep").distinct(), "rep", "left_semi").select("rep", "sk")
    sets = store(base.join(cand, F.col("doc_id") == F.col("rep")).select("rep", "sk", "text")
                 .mapInArrow(_set_batches, SET_SCHEMA), "op2-sets")
    labels = None
    for turn in range(PIVOT_ROUNDS + 1):
        heads = _open_buckets(act, turn)
        if heads.isEmpty():
            break
        open_ = act.join(heads, "bucket")
        if turn == PIVOT_ROUNDS:
            pairs = _prefix_pairs(open_, sets, threshold_pct)
        else:
            pairs = _near_pairs(open_.where(F.col("label") != F.col("pivot_label"))
                                .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct(),
                                sets, threshold_pct)
        links = _links(pairs, sets, threshold_pct)
        known = links if labels is None else links.unionAll(labels.select(F.col("v").alias("a"), F.col("label").alias("b")))
        labels = components(known, "op2-edges")
        if turn < PIVOT_ROUNDS:
            ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("more"))
            place = labels.withColumnRenamed("v", "rep").join(ends, "rep", "left")
            act = store(open_.where(F.col("rep") != F.col("pivot")).select("bucket", "rep", "degree")
                        .join(place, "rep", "left")
                        .select("bucket", "rep", F.coalesce("label", "rep").alias("label"),
                                (F.col("degree") + F.coalesce("more", F.lit(0))).alias("degree")), "op2-members")
    drop_stored(sets)
    member = reps.select("n", "f1", "f2", "rep")
    if labels is not None:
        member = (member.join(labels.withColumnRenamed("v", "rep"), "rep", "left")
                  .select("n", "f1", "f2", F.coalesce("label", "rep").alias("rep")))
    rows = sig.select("doc_id", "n", "f1", "f2")
    out = rows.join(member, ["n", "f1", "f2"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
