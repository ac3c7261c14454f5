"""Merkle manifest of a dataset as a postorder append log (operator 12).

A row is a leaf: the SHA-256 of its columns, each with its length.  The leaves
of a tree (one language) stand in order; runs of ``FAN`` nodes become a node
until one is left, and the trees' roots are the leaves of one more tree.

The log of a tree holds its nodes in the order in which they are complete, so
a log only ever grows at its end.  The place of a node follows from the sizes
of complete subtrees alone: before leaf j stand the nodes completed by j
leaves, the sum of j // FAN**k over the levels k, and a node stands last in its own
subtree, whose size is the sum of ceil(m / FAN**k) over its levels, m being
its leaves.  Aligned builders write the log: a builder gets ``FAN**LEVELS``
neighbouring leaves that start at a multiple of that number, so its nodes are
a closed subtree and a gapless piece of the log (a page).  The pages' roots
are the leaves of the next round until every tree has one page.

Proofs are read from the stored log: a page's nodes pass by in log order, and
the siblings of a leaf are picked by their closed-form places, level by level;
above the page they are those of its root, found once a page, from the last
round down.  Leaves and log are dealt by page, so one language with most of
the rows is many pages, and no task holds more than one page at a time.
Positions come from range partitions; the languages' counts are a table, which
is broadcast only up to ``TREE_BROADCAST_ROWS`` rows.

Edge cases: a null column is written ``-`` and an empty text as ``0:``; null
languages are a tree of their own, before the others; null ids come first in
a tree and are never tampered with; rows alike in id order by their leaf, rows
alike altogether each have a leaf and a proof; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nnprobe.llm.common import map_rows, running_totals, store

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 2
LEVELS = 12                           # a page has at most FAN**LEVELS leaves
TREE_BROADCAST_ROWS = 100_000         # some 40 bytes each


def leaf_digest(columns=LEAF_COLUMNS, **changed: Column) -> Column:
    """Lower-case hex digest of a row: each column as ``bytes:value``, ``-`` if null."""
    def part(name):
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def node_digest(children) -> bytes:
    """Digest of a node from its children's, taken as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def subtree_size(leaves: int, level: int) -> int:
    """Nodes of a subtree of ``leaves`` leaves whose root is on ``level``."""
    return sum(-(-leaves // FAN**k) for k in range(level + 1))


def log_place(level: int, index: int, n: int) -> int:
    """Place of the ``index``-th node of ``level`` in the log of ``n`` leaves."""
    first = index * FAN**level
    before, k = 0, first
    while k:                           # nodes that ``first`` leaves complete; none is above the tree's top
        before, k = before + k, k // FAN
    return before + subtree_size(min(first + FAN**level, n) - first, level) - 1


def siblings(index: int, n: int):
    """(level, index of a sibling) of leaf ``index`` of ``n`` up to the root, left to right."""
    level = 0
    while n > 1:
        run = index - index % FAN
        for other in range(run, min(run + FAN, n)):
            if other != index:
                yield level, other
        index, n, level = index // FAN, -(-n // FAN), level + 1


def fold(digest: bytes, index: int, n: int, proof) -> bytes:
    """The root that leaf ``index`` of ``n`` and the iterator of its siblings give."""
    while n > 1:
        run = index - index % FAN
        digest = node_digest([digest if i == index else next(proof) for i in range(run, min(run + FAN, n))])
        index, n = index // FAN, -(-n // FAN)
    return digest


class _Builder:
    """Appends the leaves of one page and yields nodes in completion order."""

    def __init__(self, leaves: int, level: int):
        self.left, self.top, self.open = leaves, level, [[] for _ in range(level + 1)]

    def append(self, digest: bytes):
        self.left -= 1
        self.open[0].append(digest)
        yield 0, digest
        for level in range(self.top):
            run = self.open[level]
            # a run is complete when full, or when no leaf can join it any more
            if len(run) < FAN and self.left:
                break
            digest = node_digest(run)
            self.open[level] = []
            self.open[level + 1].append(digest)
            yield level + 1, digest


LOG = T.StructType([T.StructField(c, T.LongType()) for c in ("tree", "page", "level", "idx", "place", "n", "leaves")]
                   + [T.StructField("is_top", T.BooleanType()), T.StructField("digest", T.BinaryType())])


def _log_round(nodes: DataFrame, r: int, levels: int, name: str) -> DataFrame:
    """The pages above (tree, idx, n, leaves, digest), the ``n`` nodes of level
    ``r * levels`` of a tree of ``leaves`` leaves; ``n`` becomes the pages of the
    tree.  Only the first round writes its lowest nodes: later ones have them."""
    block = FAN**levels
    dealt = (nodes.select("tree", F.floor(F.col("idx") / block).alias("page"), "idx", "n", "leaves", "digest")
             .repartition("tree", "page").sortWithinPartitions("tree", "page", "idx"))

    def make(rows):
        now = None
        for tree, page, _, n, leaves, digest in rows:
            if (tree, page) != now:
                now = tree, page
                builder = _Builder(min(block, n - page * block), min(levels, height(n)))
                written = [page * FAN**(levels - k) for k in range(levels + 1)]      # next index of each level
            for k, node in builder.append(digest):
                level, idx = r * levels + k, written[k]
                written[k] += 1
                if k or not r:
                    yield (tree, page, level, idx, log_place(level, idx, leaves), -(-n // block), leaves,
                           k == builder.top, node)

    return store(map_rows(dealt, make, LOG), name)


def build_log(leaves: DataFrame, name: str, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The log of (tree, idx, n, digest binary), ``n`` being the leaves of the
    tree, and the roots (tree, root).  The log is a stored table a round; together
    they hold each node once: tree, page, level, idx, place (in the tree's log),
    n (pages of the tree), leaves, is_top (the page's last node), digest."""
    nodes, rounds, roots = leaves.withColumn("leaves", F.col("n").cast("long")), [], None
    while True:
        log = _log_round(nodes, len(rounds), levels, f"{name}-{len(rounds)}")
        rounds.append(log)
        done = log.where("is_top AND n = 1").select("tree", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionAll(done)
        nodes = log.where("is_top AND n > 1").select("tree", F.col("page").alias("idx"), "n", "leaves", "digest")
        if nodes.isEmpty():
            return rounds, roots


def extract_proofs(rounds: list[DataFrame], wanted: DataFrame, levels: int = LEVELS, finish=None) -> DataFrame:
    """``wanted`` (tree, idx, n and any other columns) with ``proof``, the
    siblings' digests from the leaf to the root, left to right, one behind another;
    or what ``finish`` makes of these rows in the same task: (function of the
    columns' names that gives a function of an iterator of tuples, schema)."""
    path = None
    for r in reversed(range(len(rounds))):
        nodes = rounds[r].select("tree", "page", "place", "digest")
        if r:
            # every page below asks for the path of its root; those roots are the lowest nodes here
            below = rounds[r - 1].where("is_top AND n > 1").withColumn("idx", F.col("page")).withColumn(
                "page", F.floor(F.col("idx") / FAN**levels))
            nodes = nodes.unionAll(below.select("tree", "page", "place", "digest"))
            asked = below.select("tree", "idx", "n", "leaves")
        else:
            asked = wanted.withColumn("leaves", F.col("n").cast("long"))
        got = _extract_round(nodes, asked, path, r, levels, None if r else finish)
        path = got.select("tree", F.col("idx").alias("page"), "proof") if r else None
    return got if finish else got.drop("leaves")


def _extract_round(nodes: DataFrame, asked: DataFrame, path: DataFrame | None, r: int, levels: int, finish=None) -> DataFrame:
    """``asked`` with ``proof``: siblings within the page, then the page's own path; through ``finish`` if given."""
    asked = asked.drop("proof")
    key = [F.col("tree").alias("_tree"), F.col("page").alias("_page")]
    page = F.floor(F.col("idx") / FAN**levels)
    stream = (nodes.select(*key, F.lit(1).alias("_kind"), "place", F.col("digest").alias("_node"))
              .unionByName(asked.select(F.col("tree").alias("_tree"), page.alias("_page"), F.lit(2).alias("_kind"),
                                        F.struct(*asked.columns).alias("_asked")), allowMissingColumns=True))
    if path is not None:
        stream = stream.unionByName(path.select(*key, F.lit(0).alias("_kind"), F.col("proof").alias("_node")),
                                    allowMissingColumns=True)
    # a page's path comes first, then its nodes, then what is asked of it
    stream = (stream.select("_tree", "_page", "_kind", "place", "_node", "_asked.*")
              .repartition("_tree", "_page").sortWithinPartitions("_tree", "_page", "_kind"))
    at = {c: i + 5 for i, c in enumerate(asked.columns)}

    def make(rows):
        now = None
        for row in rows:
            if row[:2] != now:
                now, above, page_nodes, found = row[:2], b"", {}, {}
            kind = row[2]
            if kind == 0:
                above = row[4]
            elif kind == 1:
                page_nodes[row[3]] = row[4]
            else:
                proof, n, leaves = [], row[at["n"]], row[at["leaves"]]
                for level, other in siblings(row[at["idx"]], n):
                    if level >= levels:
                        break
                    node = found.get((level, other))
                    if node is None:
                        node = found[level, other] = page_nodes[log_place(r * levels + level, other, leaves)]
                    proof.append(node)
                yield (*row[5:], b"".join(proof) + above)

    if finish:
        last = finish[0]([*asked.columns, "proof"])
        return map_rows(stream, lambda rows: last(make(rows)), finish[1])
    return map_rows(stream, make, T.StructType([*asked.schema.fields, T.StructField("proof", T.BinaryType())]))


def _with_trees(rows: DataFrame, trees: DataFrame, on) -> DataFrame:
    """``rows`` with the columns of their tree: shipped whole if few, by shuffle else."""
    return rows.join(F.broadcast(trees) if trees.count() <= TREE_BROADCAST_ROWS else trees, on)


def ordered_leaves(rows: DataFrame, tree_col: str, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with tree, idx and n, stored, and the stored trees (key, tree, n).
    A tree is a value of ``tree_col``, null first; its leaves stand by ``order``."""
    placed = running_totals(rows, [F.col(tree_col).asc_nulls_first(), *order], {}, f"{name}-order")
    trees = placed.groupBy(F.col(tree_col).alias("key")).agg(F.count("*").alias("n"), F.min("_pos").alias("_start"))
    trees = store(running_totals(trees, [F.col("key").asc_nulls_first()], {}, f"{name}-trees")
                  .withColumnRenamed("_pos", "tree"), f"{name}-tree")
    leaves = _with_trees(placed, trees, F.col(tree_col).eqNullSafe(F.col("key")))
    leaves = leaves.withColumn("idx", F.col("_pos") - F.col("_start")).drop("_pos", "_start", "key")
    return store(leaves, f"{name}-leaves"), trees.drop("_start")


def manifest(docs: DataFrame, columns=LEAF_COLUMNS, id_col: str = "doc_id", tree_col: str = "lang",
             changed: dict[str, Column] | None = None, where: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root (hex digests), proof (binary, leaf
    to root), folded_root (what the leaf, with the columns ``changed`` where
    ``where`` holds, and the proof give) and verified."""
    other = F.when(where, F.unhex(leaf_digest(columns, **changed))) if changed else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(tree_col).alias("_key"),
                       F.unhex(leaf_digest(columns)).alias("digest"), other.alias("changed"))
    leaves, trees = ordered_leaves(rows, "_key", [F.col("doc_id").asc_nulls_first(), F.col("digest")], "op12")
    rounds, subroots = build_log(leaves, "op12-log", levels)
    # the trees' roots are the leaves of the last tree, in the order of the trees
    n_trees = trees.count()
    tops = store(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"),
                                 F.lit(n_trees).cast("long").alias("n"), F.col("root").alias("digest")), "op12-subroots")
    top_rounds, top_roots = build_log(tops, "op12-top", levels)
    root = (top_roots.first() or [None, None])[1]          # one row
    top = extract_proofs(top_rounds, tops, levels).select(
        F.col("idx").alias("tree"), F.col("digest").alias("_subroot"), F.col("proof").alias("_top"))
    # a tree's path goes along with its leaves, so that proofs are folded where they are picked: one Python worker a task
    asked = _with_trees(leaves.select("tree", "idx", "n", "doc_id", "digest", "changed"), store(top, "op12-paths"), "tree")
    return extract_proofs(rounds, asked, levels, folded(asked.schema["doc_id"].dataType, n_trees, root))


def folded(id_type: T.DataType, n_trees: int, root: bytes | None):
    """For ``extract_proofs``: what each leaf and its whole proof give, beside the root."""
    text, schema = T.StringType(), T.StructType([T.StructField("doc_id", id_type)])
    schema = schema.add("leaf", text).add("subroot", text).add("root", text).add("proof", T.BinaryType()).add(
        "folded_root", text).add("verified", T.BooleanType())

    def of(names):
        at = [names.index(c) for c in ("doc_id", "digest", "changed", "idx", "n", "proof", "tree", "_subroot", "_top")]

        def make(rows):
            for row in rows:
                doc_id, digest, now, idx, n, proof, tree, subroot, top = (row[i] for i in at)
                whole = proof + top
                steps = (whole[i:i + 32] for i in range(0, len(whole), 32))
                got = fold(fold(now or digest, idx, n, steps), tree, n_trees, steps)
                yield doc_id, digest.hex(), subroot.hex(), root.hex(), whole, got.hex(), got == root

        return make

    return of, schema
