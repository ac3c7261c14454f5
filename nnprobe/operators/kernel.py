"""Block distance kernels run inside ``mapInArrow``.

The query set (or the centroid set) is a bounded matrix shipped once per
executor through a broadcast variable.  Each Arrow batch of the big table
becomes one matrix product; candidates are picked on the fast product,
re-scored with the exact left-fold distance (``np_exact``) and kept under the
total order (distance, id).  Per partition only the best ``k`` rows per query
leave the task, so the shuffle that follows carries at most
``partitions x queries x k`` small rows, independent of the dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from nnprobe.functions.distance import np_bounds, np_exact, np_normalize

# Rows x queries per sub-block; a float64 array of scratch has ~8 MB, and a
# worker some ten of them at once, whatever the number of rows.
BLOCK_CELLS = 1_000_000
# Candidate pairs x dimensions re-scored at once (ties can make the candidate
# set large; re-scoring in chunks keeps memory bounded).
PAIR_CELLS = 1_000_000

# Candidates kept before they are cut back to the best k per query.
MERGE_ROWS = 200_000

# A row is a candidate, or (id NULL) the number of rows compared with a query.
TOPK_SCHEMA = "qid long, id long, distance double, compared long"
ASSIGN_SCHEMA = "id long, list_id int, list_distance double"
ASSIGN_CARRY_SCHEMA = "id long, list_id int, list_distance double, v array<float>"


def vectors_from_arrow(arr, dim: int):
    """(row_index, float32 matrix) for rows whose vector is non-NULL, of
    length ``dim`` and of finite elements (``searchable``); other rows are
    skipped.  (The data are FLOAT; the exact re-score widens to double.)"""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    offs = arr.offsets.to_numpy()
    lens = offs[1:] - offs[:-1]
    valid = lens == dim
    if arr.null_count:
        valid &= arr.is_valid().to_numpy(zero_copy_only=False)
    rows = np.nonzero(valid)[0]
    vals = arr.values.to_numpy(zero_copy_only=False)
    if dim == 0:
        return rows, np.zeros((len(rows), 0), np.float32)
    if len(rows) == n and offs[-1] - offs[0] == n * dim:
        # every row valid and packed back to back: a reshape, no gather
        x = vals[offs[0]:offs[-1]].astype(np.float32, copy=False).reshape(n, dim)
    else:
        idx = offs[:-1][rows][:, None] + np.arange(dim)[None, :]
        x = vals[idx].astype(np.float32, copy=False)
    finite = np.isfinite(x).all(axis=1)
    return rows[finite], x[finite]


def _keep_best(q, ids, d, k):
    """Best k per query under (distance, id)."""
    if len(q) == 0:
        return q, ids, d
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    start = np.r_[0, np.nonzero(q[1:] != q[:-1])[0] + 1]
    first = np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = (np.arange(len(q)) - first) < k
    return q[keep], ids[keep], d[keep]


class _Best:
    """The best k rows of every query so far, and how far the worst of them lies."""

    def __init__(self, metric: str, nq: int, k: int):
        self.metric, self.k = metric, k
        self.q, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple] = []
        self.held = 0
        self.worst = np.full(nq, np.inf)          # in the kernel's terms: l2 squared

    def add(self, q, ids, d):
        self.new.append((q, ids, d))
        self.held += len(q)
        if self.held >= MERGE_ROWS:
            self.merge()

    def merge(self):
        if not self.new:
            return
        parts = [(self.q, self.id, self.d), *self.new]
        self.q, self.id, self.d = _keep_best(*(np.concatenate([p[i] for p in parts]) for i in range(3)), self.k)
        self.new, self.held = [], 0
        last = np.r_[self.q[1:] != self.q[:-1], True] if len(self.q) else np.zeros(0, bool)
        ends = np.nonzero(last)[0]
        full = np.diff(np.r_[-1, ends]) >= self.k
        far = self.d[ends[full]]
        self.worst[self.q[ends[full]]] = far * far * (1 + 1e-9) if self.metric == "l2" else far


class _Matcher:
    """Rows meet a bounded set of queries: the best k rows of each, and the
    number of rows compared with it."""

    def __init__(self, metric: str, k: int, exclude_self: bool, dim: int, qid: np.ndarray, qm: np.ndarray):
        self.metric, self.k, self.exclude_self, self.dim = metric, k, exclude_self, dim
        self.qid, self.qm = qid, qm
        self.best = _Best(metric, len(qid), k)
        self.compared = np.zeros(len(qid), np.int64)

    def meet(self, at, x, ids):
        """Rows ``x`` meet the queries at the places ``at``."""
        best, qid = self.best, self.qid
        sub = max(1, BLOCK_CELLS // max(len(at), 1))
        for s in range(0, len(x), sub):
            xs, some = x[s:s + sub], ids[s:s + sub]
            lo, hi = np_bounds(self.metric, self.qm[at], xs)
            self.compared[at] += len(xs)
            if self.exclude_self:
                own = some[None, :] == qid[at][:, None]
                self.compared[at] -= own.sum(axis=1)
                lo[own] = np.inf
                hi[own] = np.inf
            kk = min(self.k, lo.shape[1])
            limit = np.minimum(np.partition(hi, kk - 1, axis=1)[:, kk - 1], best.worst[at])
            qi, bi = np.nonzero((lo <= limit[:, None]) & (lo < np.inf))
            step = max(1, PAIR_CELLS // max(self.dim, 1))
            for c0 in range(0, len(qi), step):
                qs, bs = at[qi[c0:c0 + step]], bi[c0:c0 + step]
                best.add(qs, some[bs], np_exact(self.metric, self.qm[qs], xs[bs]))

    def rows(self):
        """One batch of candidates, then one row per query with its count."""
        best, qid = self.best, self.qid
        best.merge()
        n, m = len(best.q), len(qid)
        if n or m:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[qid[best.q], qid], pa.int64()),
                 pa.array(np.r_[best.id, np.zeros(m, np.int64)], pa.int64(), mask=np.r_[np.zeros(n, bool), np.ones(m, bool)]),
                 pa.array(np.r_[best.d, np.zeros(m)], pa.float64(), mask=np.r_[np.zeros(n, bool), np.ones(m, bool)]),
                 pa.array(np.r_[np.zeros(n, np.int64), self.compared], pa.int64())],
                names=["qid", "id", "distance", "compared"])


def topk_per_partition(bc, metric: str, k: int, exclude_self: bool, dim: int,
                       id_col: str, vec_col: str, list_col: str | None = None):
    """mapInArrow function: per partition, the k nearest rows to every query,
    and the number of rows compared with it.

    ``bc.value`` holds ``qid`` (Q,) and ``mat`` (Q, dim).  For an inverted
    file it also holds ``offsets`` and ``members``: the queries that probe
    list l are members[offsets[l]:offsets[l + 1]], and the rows of a list
    meet only those.
    """

    def run(batches):
        payload = bc.value
        qid, qm = payload["qid"], payload["mat"]
        usable = np.isfinite(qm).all(axis=1)
        matcher = _Matcher(metric, k, exclude_self, dim, qid, qm)
        for batch in batches:
            if batch.num_rows == 0 or not usable.any():
                continue
            rows, x = vectors_from_arrow(batch.column(vec_col), dim)
            ids = batch.column(id_col).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            if list_col is None:
                matcher.meet(np.nonzero(usable)[0], x, ids)
            else:
                lists = batch.column(list_col).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
                order = np.argsort(lists, kind="stable")
                cuts = np.nonzero(np.diff(lists[order]))[0] + 1
                for part in np.split(order, cuts):
                    if len(part):
                        one = lists[part[0]]
                        at = payload["members"][payload["offsets"][one]:payload["offsets"][one + 1]]
                        at = at[usable[at]]
                        if len(at):
                            matcher.meet(at, x[part], ids[part])
            matcher.best.merge()
        yield from matcher.rows()

    return run


def topk_per_block(metric: str, k: int, exclude_self: bool, dim: int):
    """mapInArrow function over (list_id, r, q, is_row, id, v), sorted by the
    block (list_id, r, q) with its queries before its rows: the rows of a block
    meet its queries.  The queries are held, the rows pass by."""

    def run(batches):
        now, held, matcher = None, [], None

        def ready():
            qid, qm = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return _Matcher(metric, k, exclude_self, dim, qid, qm)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list_id", "r", "q", "is_row")])
            cuts = np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, key.shape[1]], strict=True):
                block, is_row = tuple(key[:3, lo]), bool(key[3, lo])
                if block != now:
                    if matcher is None and held:          # queries without rows: compared with none
                        matcher = ready()
                    if matcher is not None:
                        yield from matcher.rows()
                    now, held, matcher = block, [], None
                part = batch.slice(lo, hi - lo)
                at, x = vectors_from_arrow(part.column("v"), dim)
                ids = part.column("id").to_numpy(zero_copy_only=False)[at].astype(np.int64)
                if not is_row:
                    held.append((ids, x.astype(np.float32)))
                elif held:
                    matcher = matcher or ready()
                    if len(matcher.qid):
                        matcher.meet(np.arange(len(matcher.qid)), x, ids)
                    matcher.best.merge()
        if matcher is None and held:
            matcher = ready()
        if matcher is not None:
            yield from matcher.rows()

    return run


def nearest_centroids(bc, dim: int, k: int, normalize_rows: bool = False):
    """mapInArrow function over (qid, qv): every query's ``k`` closest centroids
    of ``bc.value`` by (l2, list id)."""

    def run(batches):
        lid, cm = bc.value["list_id"], bc.value["mat"]
        sub = max(1, BLOCK_CELLS // max(len(lid), 1))
        kk = min(k, len(lid))
        for batch in batches:
            rows, x_all = vectors_from_arrow(batch.column("qv"), dim)
            qid = batch.column("qid").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            if normalize_rows and len(rows):
                x_all = np_normalize(x_all)
            for s in range(0, len(rows) if kk else 0, sub):
                x = x_all[s:s + sub]
                lo, hi = np_bounds("l2", x, cm)
                qi, li = np.nonzero(lo <= np.partition(hi, kk - 1, axis=1)[:, kk - 1:kk])
                best = _Best("l2", len(x), kk)
                step = max(1, PAIR_CELLS // max(dim, 1))
                for c0 in range(0, len(qi), step):
                    q, at = qi[c0:c0 + step], li[c0:c0 + step]
                    best.add(q, lid[at], np_exact("l2", x[q], cm[at]))
                best.merge()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[s:s + sub][best.q]), pa.array(best.id), pa.array(best.d)], names=["qid", "id", "distance"])

    return run


def nearest_centroid(bc, dim: int, id_col: str, vec_col: str, carry_col: str | None = None,
                     normalize_rows: bool = False, so_far: bool = False):
    """mapInArrow function: every row's closest centroid by l2, ties to the
    smaller list id.  ``bc.value`` holds ``list_id`` (L,) and ``mat`` (L, dim).
    ``carry_col`` is passed through unchanged as ``v`` (the stored vector), so
    no join back is needed.  ``normalize_rows`` applies V5 to the rows here
    (numpy, bit-equal to the Spark expression) instead of in the plan.  With
    ``so_far`` the input holds list_id and list_distance of an earlier slice
    of the centroids, and the better of the two is kept."""

    def run(batches):
        payload = bc.value
        lid, cm = payload["list_id"], payload["mat"]
        nl = len(lid)
        sub = max(1, BLOCK_CELLS // max(nl, 1))
        for batch in batches:
            rows, x_all = vectors_from_arrow(batch.column(vec_col), dim)
            if normalize_rows and len(rows):
                x_all = np_normalize(x_all)
            for s in range(0, len(rows), sub):
                r, x = rows[s:s + sub], x_all[s:s + sub]
                if len(r) == 0 or nl == 0:
                    continue
                lo, hi = np_bounds("l2", x, cm)
                bi_all, li_all = np.nonzero(lo <= hi.min(axis=1)[:, None])
                step = max(1, PAIR_CELLS // max(dim, 1))
                kb, kl, kd = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for c0 in range(0, len(bi_all), step):      # tied centroids: chunked
                    bs, ls = bi_all[c0:c0 + step], li_all[c0:c0 + step]
                    kb = np.concatenate([kb, bs])
                    kl = np.concatenate([kl, lid[ls]])
                    kd = np.concatenate([kd, np_exact("l2", x[bs], cm[ls])])
                    order = np.lexsort((kl, kd, kb))
                    kb, kl, kd = kb[order], kl[order], kd[order]
                    first = np.r_[True, kb[1:] != kb[:-1]]
                    kb, kl, kd = kb[first], kl[first], kd[first]
                at = pa.array(r[kb])
                if so_far:
                    old_d = batch.column("list_distance").take(at).to_numpy(zero_copy_only=False)
                    old_l = batch.column("list_id").take(at).to_numpy(zero_copy_only=False).astype(np.int64)
                    keep = (old_d < kd) | ((old_d == kd) & (old_l < kl))
                    kd, kl = np.where(keep, old_d, kd), np.where(keep, old_l, kl)
                cols = [batch.column(id_col).take(at).cast(pa.int64()), pa.array(kl.astype(np.int32), pa.int32()),
                        pa.array(kd, pa.float64())]
                names = ["id", "list_id", "list_distance"]
                if carry_col is not None:
                    cols.append(batch.column(carry_col).take(at).cast(pa.list_(pa.float32())))
                    names.append("v")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run
