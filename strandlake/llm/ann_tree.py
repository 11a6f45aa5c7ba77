"""Nearest neighbours through a hierarchical k-means tree, best bins first.

The tree is fitted on a bounded sample (``SAMPLE_ROWS`` rows of the smallest
hashes of vec_id); the sample and so the tree, which is broadcast, have a fixed
largest size.  Every row is assigned to a leaf.  How many leaves a
search visits is calibrated: sample rows that the tree was not fitted on are searched among one another, and the
visits widen until ``TARGET`` of their true neighbours are found.  A query walks
the tree with a priority queue of centre distances, takes that many leaves, and
more while they hold fewer rows than it wants.

Queries meet the rows of their leaves by shard: neighbouring leaves of about ``BLOCK``
rows together, or blocks of one larger leaf by the hash of vec_id, so a leaf that holds a
third of all rows is many tasks; queries are dealt to shares of about ``QUERY_BLOCK``.
Each block returns its k nearest to each query among the leaves it visits, and the blocks' lists merge.

Vectors that are null, zero, of another length than most, or hold nulls or non-finite numbers take no part, nor do rows
with a null vec_id.  Ties go to the smaller vec_id.  Rows that repeat a vec_id
are candidates each, never of a query of their own vec_id; repeated query
rows are searched once, by the least vector.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K

SAMPLE_ROWS = 20_000
BRANCH = 12
LEAF_ROWS = 96
TARGET = 0.93
CALIBRATION_QUERIES = 200
BLOCK = 4096
QUERY_BLOCK = 8192

SCHEMA = "query_id long, vec_id long, score double"


class Tree:
    """Nodes with centres; leaves are numbered from 0."""

    def __init__(self, rows: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        self.branch, self.leaf_rows, self.rng = branch, leaf_rows, np.random.default_rng(seed)
        self.children: list[tuple[np.ndarray, list[int]] | None] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(rows.astype(np.float32), 0)

    def _grow(self, rows: np.ndarray, depth: int) -> int:
        me = len(self.children)
        self.children.append(None)
        self.leaf.append(-1)
        if len(rows) > self.leaf_rows and depth < 24:
            centres, label = self._kmeans(rows)
            if len(centres) > 1:
                self.children[me] = (centres, [self._grow(rows[label == k], depth + 1) for k in range(len(centres))])
                return me
        self.leaf[me] = self.leaves
        self.leaves += 1
        return me

    def _kmeans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick = [int(self.rng.integers(len(rows)))]
        least = ((rows - rows[pick[0]]) ** 2).sum(1)
        while len(pick) < self.branch and least.max() > 0:
            k = int(self.rng.choice(len(rows), p=least / least.sum(dtype=np.float64)))
            pick.append(k)
            least = np.minimum(least, ((rows - rows[k]) ** 2).sum(1))
        centres = rows[pick].copy()
        label = nearest(rows, centres)
        for _ in range(12):
            count = np.bincount(label, minlength=len(centres))
            keep = count > 0
            total = np.zeros_like(centres, dtype=np.float64)
            np.add.at(total, label, rows)
            centres = (total[keep] / count[keep, None]).astype(np.float32)
            new = nearest(rows, centres)
            if keep.all() and (new == label).all():
                break
            label = new
        used = np.unique(label)
        return centres[used], np.searchsorted(used, label)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at each level."""
        out = np.zeros(len(rows), np.int32)
        work = [(0, np.arange(len(rows)))]
        while work:
            node, at = work.pop()
            if self.children[node] is None:
                out[at] = self.leaf[node]
                continue
            centres, below = self.children[node]
            label = nearest(rows[at], centres)
            work += [(child, at[label == k]) for k, child in enumerate(below) if (label == k).any()]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bins first: always the open branch whose centre is nearest."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node] is None:
                yield self.leaf[node]
                continue
            centres, below = self.children[node]
            for d, child in zip(((centres - q) ** 2).sum(1).tolist(), below, strict=True):
                heapq.heappush(queue, (d, child))


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norm = (centres.astype(np.float64) ** 2).sum(1)
    out = np.empty(len(rows), np.int64)
    for a in range(0, len(rows), 8192):
        out[a : a + 8192] = np.argmin(norm - 2.0 * (rows[a : a + 8192].astype(np.float64) @ centres.T.astype(np.float64)), axis=1)
    return out


def top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, distance) of the k nearest rows of other ids to each query, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    rows, ids_ = rows[order].astype(np.float64), ids[order]
    out = []
    for n, q in enumerate(queries.astype(np.float64)):
        d = np.sqrt(((rows - q) ** 2).sum(1))
        d[ids_ == query_ids[n]] = np.inf
        if len(d) > k:
            limit = np.partition(d, k - 1)[k - 1]
            near = np.flatnonzero(d <= limit)
        else:
            near = np.arange(len(d))
        near = near[np.argsort(d[near], kind="stable")][:k]
        near = near[np.isfinite(d[near])]
        out.append((np.full(len(near), n), order[near], d[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def calibrate(tree: Tree, rows: np.ndarray, k: int, target: float = TARGET, queries: int = CALIBRATION_QUERIES) -> int:
    """Leaves to visit so that rows find ``target`` of their k nearest among the other rows."""
    leaf = tree.assign(rows)
    ranks = []
    pick = np.linspace(0, len(rows) - 1, min(queries, len(rows))).astype(int)
    ids = np.arange(len(rows))
    for p in pick:
        order = np.full(tree.leaves, tree.leaves)
        for n, x in enumerate(tree.visit(rows[p])):
            order[x] = n
        _, near, _ = top(rows[p : p + 1], ids[p : p + 1], rows, ids, k)
        ranks.append(order[leaf[near]])
    ranks = np.concatenate(ranks) if ranks else np.zeros(0, int)
    visits = 1
    while visits < tree.leaves and (ranks < visits).mean() < target:
        visits += 1
    return visits


def fit(sample: np.ndarray, k: int, target: float = TARGET) -> tuple[Tree, int]:
    """A tree of two thirds of a sample, and visits calibrated on the rest, which it has not seen; a small sample does both."""
    if len(sample) < 600:
        tree = Tree(sample)
        return tree, calibrate(tree, sample, k, max(target, 0.99))
    cut = 2 * len(sample) // 3
    tree = Tree(sample[:cut])
    return tree, calibrate(tree, sample[cut:], k, target)


def shards(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each leaf, blocks of each shard): neighbouring leaves of up to ``block`` rows in all, or one larger leaf in blocks."""
    shard, blocks, held = np.zeros(len(counts), np.int32), [], 0
    for x, n in enumerate(counts.tolist()):
        if not blocks or held + n > block:
            blocks.append(max(1, -(-n // block)))
            held = 0
        held += n
        shard[x] = len(blocks) - 1
    return shard, np.array(blocks or [1], np.int32)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32 if pa.types.is_float32(column.type.value_type) else np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (sizes.n if sizes else 0))


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of which the column ``is_query`` (over vec_id) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    if sample.num_rows == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree, visits = fit(_matrix(sample.column("vector")), k, target)
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = sent.value.assign(_matrix(b.column("vector")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array(leaf, pa.int32())], names=["vec_id", "vector", "leaf"])

    kind = rows.schema["vector"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"vec_id long, vector {kind}, leaf int")
    held = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row a leaf, of at most sample_rows leaves
    counts = np.array([held.get(x, 0) for x in range(tree.leaves)], np.int64)
    shard, blocks = shards(counts, block)
    wanted = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shares = max(1, -(-wanted.count() // QUERY_BLOCK))

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("vector"))
            at, into, salt, chosen = [], [], [], []
            for n, x in enumerate(q):
                got = seen = 0
                by_shard: dict[int, list[int]] = {}
                for y in sent.value.visit(x):
                    if seen >= visits and got > k:
                        break
                    seen += 1
                    got += int(counts[y])
                    if counts[y]:
                        by_shard.setdefault(int(shard[y]), []).append(y)
                for z, leaves in by_shard.items():
                    for part in range(int(blocks[z])):
                        at.append(n)
                        into.append(z)
                        salt.append(part)
                        chosen.append(sorted(leaves))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("vector").take(take), pa.array(into, pa.int32()), pa.array(salt, pa.int32()), pa.array(chosen, pa.list_(pa.int32()))], names=["query_id", "vector", "shard", "salt", "leaves"])

    share = lambda c: F.pmod(F.xxhash64(c), F.lit(shares)).cast("int")
    queries = wanted.mapInArrow(routes, f"query_id long, vector {kind}, shard int, salt int, leaves array<int>").withColumn("share", share("query_id"))
    of = spark.createDataFrame([(x, int(shard[x]), int(blocks[shard[x]])) for x in range(tree.leaves)], "leaf int, shard int, blocks int")
    dealt = placed.join(F.broadcast(of), "leaf").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def compare(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            v = v.sort_values("leaf", kind="stable")
            leaf, ids, x = v["leaf"].to_numpy(), v["vec_id"].to_numpy(), np.stack(v["vector"].to_list())
            for query_id, vector, leaves in zip(q["query_id"], q["vector"], q["leaves"], strict=True):
                begin = np.searchsorted(leaf, leaves)
                mine = K.ranges_concat(begin, np.searchsorted(leaf, leaves, side="right") - begin)
                _, near, d = top(vector[None], np.array([query_id]), x[mine], ids[mine], k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[mine][near], "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    keys = ["shard", "salt", "share"]
    found = queries.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(compare, SCHEMA)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
